"""Archives with several members, broken ones, plain bodies."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from regolith.sources import archives as A


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.mkdir("folder")
        for i, (name, text) in enumerate(files.items()):
            z.writestr(name.replace("__", "."), text, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def events(spark, bodies, **how):
    df = spark.createDataFrame(bodies, "url string, body binary")
    out = A.adverse_event_files(df, "caers", ["zinc", "rash"], F.lit("2024-01-31").cast("timestamp_ntz"), **how)
    return sorted((r.url, r.title, r.body_text) for r in out.collect())


def test_first_csv_member_and_limits(spark):
    many = "Product,Reactions\n" + "".join(f"Zinc {i},\n" for i in range(100_000))
    big = zipped(readme__txt="PRODUCT\nzinc in a note\n", a__csv=many, b__csv="PRODUCT\nZinc second\n")
    got = events(spark, [("u.zip", big)])
    assert [t for _, t, _ in got] == sorted(f"Adverse Event: Zinc {i}" for i in range(10))
    assert len(events(spark, [("u.zip", big)], read=5)) == 5
    rows = A.csv_rows(A.members(spark.createDataFrame([("u.zip", big)], "url string, body binary"))).groupBy("member").count().collect()
    assert {r.member: r["count"] for r in rows} == {"readme.txt": 1, "a.csv": 20, "b.csv": 1}


def test_aliases_quotes_and_all_fields(spark):
    text = '﻿product_name,event_type,OUTCOME,report_date\n"Zinc ""Plus"", 50\nmg",nausea, ok ,2024-01-02\n,rash,,\nSteel,,,\nOil,Rash,,\n'
    got = events(spark, [("x.csv", text.encode())])
    assert [t for _, t, _ in got] == ["Adverse Event: Oil", 'Adverse Event: Zinc "Plus", 50\nmg']
    assert "Outcome: ok\nReport Date: 2024-01-02\nAll fields: {'product_name': 'Zinc \"Plus\", 50\\nmg', 'event_type': 'nausea', 'OUTCOME': ' ok ', 'report_date': '2024-01-02'}" in got[1][2]


def test_broken_and_empty_bodies(spark):
    whole = zipped(a__csv="PRODUCT\nZinc\n", b__csv="PRODUCT\nx\n")
    lost = bytearray(zipped(a__txt="", a__csv="PRODUCT\n" + "Zinc\n" * 9))
    lost[len(lost) // 4] ^= 255
    bodies = [("cut.zip", whole[:40]), ("none.csv", b""), ("null.csv", None), ("page.html", b"PRODUCT\nZinc\n"), ("bad.csv", b"PRODUCT,A\nZinc \xff,1,2,3\n"), ("header.csv", b"PRODUCT\n"), ("lost.zip", bytes(lost))]
    assert [x for x in events(spark, bodies) if x[0] != "lost.zip"] == [("bad.csv", "Adverse Event: Zinc �", "Source: CAERS Adverse Event Report\nProduct: Zinc �\nAdverse Event / Reactions: \nOutcome: \nReport Date: \nAll fields: {'PRODUCT': 'Zinc �', 'A': '1', None: ['2', '3']}")]
