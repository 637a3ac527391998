"""Fixed rule tables.  Order matters: the first match, or the first of equal scores, wins."""

from __future__ import annotations

# Facility types by phrase
FACILITY = [
    ("Supplement / Nutraceutical", ["supplement", "dietary supplement", "nutraceutical", "vitamin", "mineral", "herbal", "botanical", "probiotic", "food supplement", "complementary medicine", "sports nutrition", "omega-3", "fish oil", "protein powder"]),
    ("Sterile / Parenteral", ["sterile", "aseptic", "parenteral", "injectable", "lyophilized", "lyophilisation", "fill-finish", "fill finish", "vial", "ampoule", "ampule", "autoclave", "endotoxin", "depyrogenation", "cleanroom", "iso-5", "isolator"]),
    ("Biologics / Vaccine", ["biologic", "biologics", "vaccine", "viral", "cell culture", "fermentation", "purification", "monoclonal antibody", "plasma", "blood product", "gene therapy", "recombinant", "biosimilar", "mab", "immunoglobulin", "antigen", "cber"]),
    ("API Manufacturer", ["active pharmaceutical ingredient", "api", "active substance", "drug substance", "synthesis", "chemical synthesis", "starting material", "intermediate"]),
    ("CMO", ["contract manufacturer", "contract manufacturing", "cmo", "cdmo", "contract development", "contract organization", "third-party manufacturer"]),
    ("Medical Device", ["medical device", "in vitro diagnostic", "ivd", "implant", "catheter", "stent", "surgical instrument", "class ii device", "class iii device", "510(k)", "pma", "510k"]),
    ("Compounding", ["compounding", "compounded", "compound pharmacy", "503b", "503a", "hospital compounding", "outsourcing facility"]),
]

# Practice categories by phrase
CATEGORY = [
    ("Sterility assurance", ["sterility", "sterile assurance", "sar", "sterility failure"]),
    ("Aseptic processing", ["aseptic", "aseptic technique", "aseptic fill", "grade a", "grade b", "cleanroom"]),
    ("Environmental monitoring", ["environmental monitoring", "em program", "em data", "viable particle", "bioburden"]),
    ("Container closure integrity", ["container closure", "cci", "seal integrity", "leachable", "extractable"]),
    ("Parenteral manufacturing", ["parenteral", "injectable", "lyophilized", "fill-finish", "vial", "ampoule"]),
    ("API synthesis and control", ["api", "active substance", "drug substance", "synthesis", "starting material"]),
    ("Biological product specific", ["biologic", "cell culture", "fermentation", "viral clearance", "purification", "mab"]),
    ("Computerised systems validation", ["csv", "computer", "software", "audit trail", "21 cfr part 11", "electronic record"]),
    ("Deviation management", ["deviation", "oos", "out of specification", "ooc", "investigation", "capa"]),
    ("Change control", ["change control", "change management"]),
    ("Batch release", ["batch release", "batch disposition", "lot release", "certificate of analysis", "qp release"]),
    ("Stability programme", ["stability", "shelf life", "expiry", "degradation", "accelerated stability"]),
    ("Cold chain and storage", ["cold chain", "refrigerated", "frozen", "temperature excursion", "2-8", "cryogenic"]),
    ("Training & competency", ["training", "competency", "qualified person", "qualification", "personnel"]),
    ("Documentation & record keeping", ["documentation", "record", "batch record", "sop", "logbook", "data integrity"]),
    ("GMP violations", ["cgmp", "good manufacturing practice", "gmp violation"]),
    ("Labelling & claims", ["label", "claim", "misleading", "unapproved claim", "false claim"]),
    ("Contamination & sterility", ["contamination", "microbial", "salmonella", "listeria", "foreign material", "particulate"]),
    ("Supply chain & procurement", ["supplier", "vendor", "procurement", "raw material", "fsvp", "contract"]),
    ("Equipment & facilities", ["equipment", "facility", "calibration", "sanitation", "cleaning", "maintenance"]),
    ("Quality management system", ["quality system", "qms", "quality management", "audit", "pharmaceutical quality"]),
    ("Ingredient safety", ["undeclared", "adulterant", "identity", "purity", "potency", "nitrosamine", "impurity"]),
]

# Failure modes by phrase
FAILURE_MODE = [
    ("contamination_microbial", ["microbial contamination", "bioburden", "salmonella", "listeria", "e. coli", "mold", "yeast", "bacterial", "microbial limits", "microbial testing"]),
    ("contamination_chemical", ["chemical contamination", "nitrosamine", "solvent residue", "heavy metal", "heavy metals", "lead contamination", "lead impurity", "blood lead", "lead levels", "arsenic contamination", "arsenic impurity", "mercury contamination", "cadmium contamination", "genotoxic impurity", "elemental impurity", "residual solvent", "benzene contamination", "toxic element", "ndma", "ndea", "nmba"]),
    ("contamination_foreign", ["foreign material", "foreign matter", "particulate", "glass particle", "metal fragment", "visible particle", "foreign body"]),
    ("inadequate_testing", ["out-of-specification", "oos", "failed testing", "inadequate testing", "analytical method", "method validation", "purity", "potency", "identity test", "lab investigation"]),
    ("inadequate_stability", ["stability", "shelf life", "expiry", "degradation", "accelerated stability", "stability data", "stability programme", "stability testing"]),
    ("inadequate_documentation", ["data integrity", "audit trail", "falsification", "data manipulation", "batch record incomplete", "logbook", "electronic record", "sop not followed", "records not maintained"]),
    ("equipment_calibration", ["calibration", "equipment qualification", "iq oq pq", "instrument calibration", "equipment maintenance", "preventive maintenance", "unqualified equipment"]),
    ("cleaning_validation", ["cleaning validation", "cleaning procedure", "cross-contamination prevention", "cleaning effectiveness", "equipment cleaning", "cleaning agent"]),
    ("sterility_assurance", ["sterility assurance", "sterility failure", "sterility testing", "sterile manufacturing", "terminal sterilization", "sterility", "endotoxin", "aseptic"]),
    ("supplier_qualification", ["supplier qualification", "vendor qualification", "supplier audit", "raw material supplier", "contract manufacturer qualification", "fsvp", "foreign supplier", "unqualified supplier"]),
    ("out_of_specification", ["out of specification", "oos result", "non-conforming", "failed release", "batch failure", "spec exceedance", "release failure"]),
    ("process_validation", ["process validation", "validation failure", "unvalidated process", "process control", "in-process testing", "cpv", "validation protocol"]),
    ("labelling_error", ["labelling error", "misbranding", "mislabeled", "false claim", "misleading label", "incorrect label", "unapproved claim", "label mix-up", "undeclared"]),
    ("import_detention", ["import alert", "import detention", "detention without examination", "automatic detention", "dwpe", "import refusal"]),
    ("recall_voluntary", ["voluntary recall", "class iii recall", "voluntary removal", "market withdrawal", "precautionary recall"]),
    ("recall_mandatory", ["class i recall", "class ii recall", "mandatory recall", "urgent recall"]),
    ("adverse_event_cluster", ["adverse event", "serious adverse", "hospitaliz", "death", "injury report", "adr cluster", "medwatch", "serious injury"]),
    ("facility_hygiene", ["facility sanitation", "pest control", "facility maintenance", "building maintenance", "facility hygiene", "sanitation failure", "pest infestation"]),
]

# Phrases that support a category
EVIDENCE = {
    "Deviation management": ["deviation", "nonconformance", "non-conformance", "capa", "corrective action", "preventive action", "investigation", "failure investigation", "root cause", "oos", "out-of-specification", "out of specification", "complaint investigation", "discrepancy investigation", "discrepancy", "nonconformity", "non-conformity"],
    "Quality management system": ["quality unit", "quality system", "quality management system", "qms", "management review", "quality oversight", "quality agreement", "change control system", "complaint system", "capa system", "quality assurance", "pharmaceutical quality system", "pqs"],
    "Computerised systems validation": ["computer system validation", "csv", "computerized system", "computerised system", "electronic record", "electronic signature", "audit trail", "access control", "data integrity", "part 11", "annex 11", "21 cfr part 11", "software validation"],
    "Equipment & facilities": ["equipment", "facility", "facilities", "calibration", "maintenance", "cleaning validation", "hvac", "utilities", "water system", "premises", "sanitation", "cleanroom", "preventive maintenance", "equipment qualification"],
    "Documentation & record keeping": ["batch record", "master record", "sop", "standard operating procedure", "procedure", "documentation", "recordkeeping", "record keeping", "logbook", "certificate of analysis", "coa", "batch manufacturing record", "protocol"],
    "Labelling & claims": ["label", "labelling", "labeling", "misbranded", "misbranding", "claim", "disease claim", "false or misleading", "unapproved claim", "label mix-up", "incorrect label", "health claim"],
    "Sterility assurance": ["sterility", "sterile", "aseptic", "endotoxin", "bioburden", "sterility testing", "sterility failure", "terminal sterilization", "sterilisation", "depyrogenation"],
    "Contamination & sterility": ["contamination", "contaminated", "microbial", "salmonella", "listeria", "e. coli", "mold", "yeast", "foreign material", "foreign matter", "particulate", "cross-contamination"],
    "GMP violations": ["cgmp", "good manufacturing practice", "gmp violation", "current good manufacturing", "21 cfr 211", "eu gmp", "non-compliance with gmp"],
    "Ingredient safety": ["undeclared", "adulterant", "adulterated", "identity", "purity", "potency", "nitrosamine", "impurity", "undeclared drug substance"],
    "Training & competency": ["training", "competency", "qualified person", "qualification", "personnel", "gmp training", "training programme"],
    "Supply chain & procurement": ["supplier", "vendor", "procurement", "raw material supplier", "fsvp", "foreign supplier", "contract manufacturer", "supply chain", "supplier qualification"],
    "Aseptic processing": ["aseptic", "aseptic technique", "aseptic fill", "grade a", "grade b", "cleanroom", "laminar air flow", "media fill"],
    "Environmental monitoring": ["environmental monitoring", "em program", "em data", "viable particle", "bioburden monitoring", "air sample"],
    "Stability programme": ["stability", "shelf life", "expiry", "degradation", "accelerated stability", "stability data"],
}

# patterns
HIGH = r"death|fatal|hospitali|life.threatening|serious adverse|serious risk|salmonella|listeria|e\. coli|clostridium|undeclared drug|sildenafil|tadalafil|sibutramine|sarms|dmaa|anabolic|urgent|immediate cessation|injunction|seizure|counterfeit|falsified|sterility failure|contaminated batch|endotoxin exceedance|nitrosamine|carcinogen|genotoxic"
LOW = r"guidance document|information update|scientific opinion|surveillance report|monitoring report|advisory notice"
CLASS_ONE = r"class.?i\b(?!.*class.?ii)"
CRITICAL = r"\brecall\b|injunction|seizure|death|fatal|counterfeit|falsified|carcinogen|genotoxic"
TOBACCO = r"tobacco control act|family smoking prevention|tobacco product\b|\bends\b|electronic nicotine delivery|nicotine delivery system|\be-cigarette|\bvape\b|vaping|e-vapor|e-liquid|hookah|cigar\b|menthol cigarette|modified risk tobacco"
PHARMA_SAFETY = r"class\s+i\s+recall|class\s+ii\s+recall|mandatory recall|urgent recall|sterility failure|microbial contamination|salmonella|listeria|heavy metal|lead content|arsenic|nitrosamine|undeclared drug|sildenafil|tadalafil|sibutramine|serious adverse event|patient harm|hospitaliz|death|fatal|carcinogen|genotoxic"
CHEMICAL = r"\bbenzene\b|\bndma\b|\bndea\b|\bnmba\b|\barsenic\b|\bmercury\b|\bcadmium\b"
LOW_DETAIL_SAFETY = r"\bsterility\b|\bmicrobial\b|\bcontamination\b|\bbenzene\b|\bnitrosamine\b|\bndma\b|\bndea\b|\bnmba\b|\bheavy metal|\btoxic element|\bundeclared drug\b|\bsildenafil\b|\btadalafil\b|\bsibutramine\b|\bsarms\b|\bdmaa\b|class\s+i\s+recall|\bserious adverse event\b|\bpatient harm\b|\bdeath\b|\bhospitali[sz]"
GUIDANCE_URL = r"/guidance/|/guidelines?/|/consultations?/|/scientific.opinions?/|onlinelibrary\.wiley\.com|efsa\.europa\.eu|bfr\.bund\.de"
GUIDANCE_TITLE = r"\bguideline\b|\bguidance\b|\bconsultation\b|\bopinion\b|\bassessment\b|\bmonitoring report\b|\bscientific report\b|\bscientific statement\b|\btechnical report\b|\bpeer review\b|\bflavour(?:ing)?\b|\bfeed additive\b"
ENFORCEMENT_SIGNAL = r"\bnon.compliance\b|\bdeficiency\b|\bviolation\b|\benforcement\b|\bwarning letter\b|\brecall\b|\bsuspension\b|\binjunction\b|\bdefective medicine\b|\binspection finding\b"
CONTRACT = r"contract manufactur|cmo|cdmo|outsourc"

# domains
NO_DETAIL = "Other / Insufficient Detail"
MEDIUM_TYPES = ["warning_letter", "483_observation", "inspection_finding", "drug_enforcement", "device_enforcement", "import_alert"]
ENFORCEMENT = ["drug_enforcement", "device_enforcement", "food_enforcement"]
STRONG = ["warning_letter", *ENFORCEMENT, "recall", "import_alert"]
NOT_ENFORCEMENT = ["guidance", "scientific_opinion", "regulatory_update", "consultation"]
HIGH_RISK_MODES = ["sterility_assurance", "contamination_microbial", "contamination_chemical", "contamination_foreign", "adverse_event_cluster", "recall_mandatory", "out_of_specification"]

# facets
INVALID_INGREDIENT = ["none", "n/a", "na", "unknown", "-", "–", "—", "other", "tbd", "tba", "various", "multiple"]
DI_CAPA = ["computerised systems validation", "data integrity", "deviation management", "audit trail", "capa", "csv"]
NOISE = ["about", "more information", "subscribe", "report", "publication", "resource", "education", "conference", "opinion", "communication"]
ENFORCEMENT_TYPES = ["warning_letter", "inspection_finding", "recall", "import_alert", "safety_alert", "483", "compliance_action", "drug_enforcement", "device_enforcement", "food_enforcement"]
JUNK_EXACT = ["about", "comics", "subscribe", "newsletter", "publications", "resources", "other"]
JUNK_START = ["subscribe to", "press release", "general information", "to the medium", "newsletter", "comics", "more about"]
ACTION_VERBS = ["warning", "inspection", "recall", "violation", "alert", "detention", "contamination", "adulterat", "mislabel", "misbrand", "defect", "unsafe", "prohibited", "unapproved", "finding", "enforcement", "non-compliance", "gmp", "cgmp", "gdp", "import"]
BROAD = ["GMP violations", "Other / Insufficient Detail", "Other", ""]
REPORT_CATEGORY = [
    ("Manufacturing Procedures", ["manufacturing procedure", "production process", "batch record", "manufacturing control"]),
    ("Contamination / Foreign Material", ["contamination", "foreign material", "foreign matter", "microbial", "cross-contamination"]),
    ("Labelling / Misbranding", ["label", "misbranding", "mislabeled", "false claim", "misleading label", "unapproved claim"]),
    ("Quality Control / Testing", ["quality control", "qc testing", "analytical testing", "out-of-specification", "oos result"]),
    ("Documentation / Recordkeeping", ["record", "documentation", "coa", "certificate of analysis", "master formula", "sop"]),
    ("Equipment / Facilities", ["equipment", "facility", "sanitation", "cleaning validation", "calibration", "maintenance"]),
    ("Supplier Qualification", ["supplier", "vendor qualification", "raw material supplier", "contract manufacturer", "fsvp", "foreign supplier", "importer"]),
    ("Identity / Purity Testing", ["identity test", "purity", "adulterant", "undeclared ingredient", "active pharmaceutical", "drug substance"]),
    ("Undeclared Drug Substance", ["undeclared", "sildenafil", "tadalafil", "sibutramine", "phenolphthalein", "fluoxetine"]),
    ("CGMP Non-compliance", ["cgmp", "current good manufacturing", "gmp violation", "gmp non-compliance"]),
]
REPORT_HIGH = ["death", "hospitali", "life-threatening", "serious adverse", "serious risk", "critical", "urgent", "immediate", "ban", "banned", "seizure", "injunction", "salmonella", "listeria", "e. coli", "counterfeit", "undeclared drug", "sildenafil", "tadalafil", "sibutramine", "sarms", "dmaa", "dmha", "anabolic steroid", "recall class i", "class i recall"]
REPORT_LOW = ["opinion", "information", "update", "guidance", "review", "assessment", "monitoring", "surveillance", "report"]

# Ingredient terms looked for in titles, in their order
KNOWN_INGREDIENTS = [
    "ashwagandha", "turmeric", "curcumin", "melatonin", "probiotic", "probiotics", "omega-3", "omega 3", "collagen", "magnesium", "vitamin d", "vitamin c",
    "vitamin b", "zinc", "iron", "calcium", "creatine", "caffeine", "cbd", "cannabidiol", "berberine", "resveratrol", "coq10", "coenzyme q10",
    "nmn", "nad+", "glutathione", "quercetin", "folic acid", "folate", "biotin", "selenium", "iodine", "fish oil", "krill oil", "spirulina",
    "chlorella", "maca", "ginseng", "echinacea", "valerian", "chamomile", "st. john", "ginkgo", "ginkgo biloba", "saw palmetto", "black cohosh", "evening primrose",
    "milk thistle", "rhodiola", "holy basil", "bacopa", "lion's mane", "reishi", "chaga", "saffron", "garlic", "cinnamon", "ginger", "beetroot",
    "acai", "elderberry", "lutein", "lycopene", "beta-carotene", "astaxanthin", "phosphatidylserine", "alpha lipoic", "acetyl-l-carnitine", "l-carnitine", "l-theanine", "5-htp",
    "tryptophan", "glucosamine", "chondroitin", "msm", "hyaluronic acid", "colostrum", "whey protein", "pea protein", "betaine", "arginine", "citrulline", "beet",
    "nitrate", "peptide", "bpc-157", "tb-500", "ghk-cu", "artri ajo", "sea buckthorn", "inositol", "chromium", "boron", "silicon", "strontium",
    "lithium", "manganese", "molybdenum", "copper", "potassium", "sodium bicarbonate", "sodium phosphate", "beta-alanine", "hmb", "cla", "green tea", "egcg",
    "raspberry ketone", "glucomannan", "psyllium", "inulin", "fos", "mos", "lactulose", "xylitol", "stevia", "monk fruit",
]
# Phrases, categories and failure modes of the equipment trace
EQUIPMENT_TERMS = ["equipment", "facilit", "calibration", "maintenance", "hvac", "utilities", "water system", "premises", "sanitation", "qualification", "installation", "repair", "preventive"]
EQUIPMENT_CATEGORIES = ["Equipment & facilities", "Equipment / Facilities"]
EQUIPMENT_MODES = ["equipment_facilities", "equipment_facility", "cleaning_validation", "calibration"]
