"""Line-first quality rules in DataFrame functions.

Every line is judged alone; a document's verdict is what the lines leave of it.  A line
fails as

* navigation: two separators (``|»›·•``) or more and at least one to four words, or two links
  or more and at least one to four words;
* symbols: three of ``#*$%&<>`` or more and more than one to two words;
* shouting: four ``!`` or more and more than one to two words;
* boilerplate: at most ``boiler_words`` words and a stock phrase of page furniture in English,
  German, French or Spanish (``BOILERPLATE``);
* punctuation: fewer than ``least_open`` words and no closing mark at its end.

Failed lines are removed; a document that keeps less than ``least_left`` of its non-blank
line characters is rejected.  Before that, documents under ``least_words`` words or with
over 20 % of their words inside repeated ``k``-word windows fail the base rules.

Repeated windows are found inside the row: where a text has equal 64-bit hashes at all, a sort of
(hash, position) brings equal windows together, and gaps between repeated positions add up
to the words covered.  There is no shuffle and no Python.

Defined results: null and blank texts have zero counts and fail the base rules; rows are
judged one by one, so repeated or null ids are kept as they come; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import SPACE, SPACE_RUN, count_of, stripped, window_hashes, without, words
from .textkit import required

#: Stock phrases of page furniture, lower case, by language.
BOILERPLATE = {
    "en": (
        "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "enable javascript",
        "lorem ipsum", "licensed under", "copyright", "subscribe to", "click here", "sign in", "log in", "share this",
        "read more", "skip to content", "back to top", "accept cookies",
    ),
    "de": ("alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "cookie-richtlinie", "anmelden", "hier klicken", "weiterlesen", "newsletter abonnieren", "zum inhalt springen", "nach oben"),
    "fr": ("tous droits réservés", "mentions légales", "politique de confidentialité", "conditions d'utilisation", "se connecter", "cliquez ici", "lire la suite", "abonnez-vous", "accepter les cookies", "haut de page"),
    "es": ("todos los derechos reservados", "aviso legal", "política de privacidad", "términos de uso", "iniciar sesión", "haga clic aquí", "leer más", "suscríbete", "aceptar cookies", "volver arriba"),
}
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›·•"
CLOSING = r"[.!?:;…\"')\]»”。！？]$"
LINK = r"https?://|www\."
GAP = r"[\x20\x09\x0B-\x0D]"


def line_fails(x: Column, boiler_words: int = 25, least_open: int = 8, marks: Column | None = None, links: Column | None = None, gaps: Column | None = None) -> Column:
    """Whether a stripped, non-empty line breaks a rule.

    ``marks``, ``links`` and ``gaps`` say whether the document has any of the counted marks, any link and any
    two white-space characters together; if not, no line is searched for them."""
    n = 1 + count_of(x, " \t\x0b\x0c\r")
    n = F.when(F.lit(True) if gaps is None else gaps, F.size(F.split(x, SPACE_RUN))).otherwise(n)
    marked = lambda chars: count_of(x, chars) if marks is None else F.when(marks, count_of(x, chars)).otherwise(0)
    bars, symbols, shouts = marked(SEPARATORS), marked("#*$%&<>"), marked("!")
    linked = F.regexp_count(x, F.lit(LINK)) if links is None else F.when(links, F.regexp_count(x, F.lit(LINK))).otherwise(0)
    low = F.lower(x)
    stock = F.lit(False)
    for phrases in BOILERPLATE.values():
        for phrase in phrases:
            stock = stock | low.contains(phrase)
    return (
        ((bars >= 2) & (bars * 4 >= n))
        | ((linked >= 2) & (linked * 4 >= n))
        | ((symbols >= 3) & (symbols * 2 > n))
        | ((shouts >= 4) & (shouts * 2 > n))
        | ((n <= boiler_words) & stock)
        | ((n < least_open) & ~x.rlike(CLOSING))
    )


def quality_rules(docs: DataFrame, k: int = 5, least_words: int = 10, least_left: float = 0.5, boiler_words: int = 25, least_open: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_failed_lines, left_share, cleaned) a row; ``cleaned`` is the text without failed lines."""
    d = required(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words(F.col("text")))
    d = d.withColumn("lines", F.filter(F.transform(F.split("text", "\n", -1), stripped), lambda x: x != ""))
    d = d.select(
        "doc_id", "text", "lines",
        F.size("w").cast("long").alias("n_words"),
        F.filter(F.split("text", "\n", -1), lambda x: stripped(x) != "").alias("raw_lines"),
        F.length(without(F.col("text"), SPACE)).cast("long").alias("word_chars"),
        count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.col("text").rlike("[#*$%&<>!" + SEPARATORS + "]").alias("marks"),
        F.col("text").rlike(LINK).alias("links"),
        F.col("text").rlike(GAP + GAP).alias("gaps"),
        window_hashes("w", k).alias("h"),
    )
    again = F.size(F.array_distinct("h")) < F.size("h")
    d = d.withColumn("keys", F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p"))))))
    same = lambda x, i: F.coalesce(x["h"] == F.get(F.col("keys"), i)["h"], F.lit(False))
    d = d.withColumn("at", F.array_sort(F.transform(F.filter("keys", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])))
    steps = F.transform("at", lambda p, i: F.when(i == 0, F.lit(k).cast("long")).otherwise(F.least(F.lit(k).cast("long"), p - F.get(F.col("at"), i - 1))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    total = lambda c: F.aggregate(F.transform(c, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("good", F.filter("lines", lambda x: ~line_fails(x, boiler_words, least_open, F.col("marks"), F.col("links"), F.col("gaps"))))
    d = d.withColumn("left_share", F.when(F.size("lines") == 0, 0.0).otherwise(total("good") / total("lines")))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("raw_lines") - F.size(F.array_distinct("raw_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("left_share") >= least_left)).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        "left_share",
        F.array_join("good", "\n").alias("cleaned"),
    )
