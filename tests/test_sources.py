import os
import tempfile

import pytest

from clickgap.config import REQUIRED_PAGE_FIELDS, REQUIRED_QUERY_FIELDS
from clickgap.sources import exports, keywords, sinks


def test_header_mapping_rules():
    m = exports.choose_headers(["Top queries", "Klikken", "Weergaven", "CTR", "Positie"],
                                      REQUIRED_QUERY_FIELDS)
    assert m == {"query": "Top queries", "clicks": "Klikken", "impressions": "Weergaven",
                 "ctr": "CTR", "position": "Positie"}
    # partial match of an earlier pattern beats an exact match of a later one
    m = exports.choose_headers(["page url", "url"], {"page": ["page", "url"]})
    assert m["page"] == "page url"
    assert exports.choose_headers(["Query", "QUERY "], {"query": ["query"], "x": ["zz"]}) == {"query": "QUERY ", "x": None}
    assert exports.choose_headers(["a", "b"], {"query": ["a"]}, {"query": "b"})["query"] == "b"


def test_missing_headers_raise(spark):
    df = spark.createDataFrame([("x",)], "x string")
    with pytest.raises(ValueError, match="no header"):
        exports.rename_fields(df, exports.choose_headers(["x"], REQUIRED_PAGE_FIELDS), exports.PAGE_TARGETS, "pages")
    with pytest.raises(ValueError, match="nope"):
        exports.rename_fields(df, dict.fromkeys(exports.PAGE_TARGETS, "nope"), exports.PAGE_TARGETS, "pages")


def test_extra_columns_manual_mapping_and_file_order(spark):
    d = tempfile.mkdtemp(prefix="cg-exports-")
    head = "Country,Query,Hits,Impressions,CTR,Position,Clicks\n"
    for name, rows in (("a", 1), ("b", 500), ("c", 20)):
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write(head + "".join(f"nl,{name}{i},{i},1,,,{i + 7}\n" for i in range(rows)))
    with open(os.path.join(d, "d.csv"), "w") as f:
        f.write("Query,Hits,Impressions,CTR,Position,Device\n\"two\nlines\",4,1,,,mobile\n")
    df = exports.read_exports(spark, d, mapping={"clicks": "Hits"})
    rows = df.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(522))
    assert [r["query"] for r in rows] == ["a0"] + [f"b{i}" for i in range(500)] + [f"c{i}" for i in range(20)] + ["two\nlines"]
    assert rows[3]["clicks"] == "2" and rows[3]["Country"] == "nl" and rows[3]["Clicks_source"] == "9"
    assert rows[-1]["Device"] == "mobile" and rows[-1]["Country"] is None


def test_read_exports_two_languages(spark):
    d = tempfile.mkdtemp(prefix="cg-exports-")
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("Top queries,Clicks,Impressions,CTR,Position\nred shoes,5,100,5%,3.2\n\"a, b\",1,10,,7\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("Zoekopdracht,Klikken,Weergaven,CTR,Positie\nrode schoenen,2,20,10%,1.5\n")
    df = exports.read_exports(spark, d, "queries")
    rows = sorted((r["query"], r["clicks"]) for r in df.collect())
    assert rows == [("a, b", "1"), ("red shoes", "5"), ("rode schoenen", "2")]
    assert df.select("row_id").distinct().count() == 3


def test_keyword_config_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="cg-kw-")
    path = os.path.join(d, "kw")
    keywords.write_keyword_config(spark, {"navigational": ["login"], "commercial": ["best", "top"]}, path)
    cfg = keywords.read_keyword_config(spark, path)
    assert keywords.to_dict(cfg) == {"navigational": ["login"], "commercial": ["best", "top"]}
    assert {r["intent"]: r["keywords"] for r in keywords.keyword_counts(cfg).collect()} == \
        {"navigational": 1, "commercial": 2}
    assert keywords.parse_keyword_text(" a, b\n\nc ,") == ["a", "b", "c"]


def test_sinks_write(spark):
    d = tempfile.mkdtemp(prefix="cg-sink-")
    df = spark.createDataFrame([("s1", [1, 2]), ("s2", [3])], "segment string, v array<int>")
    sinks.write_csv(df, os.path.join(d, "csv"), partition_by="segment")
    back = spark.read.option("header", True).csv(os.path.join(d, "csv"))
    assert sorted(r["v"] for r in back.collect()) == ["[1,2]", "[3]"]


def test_export_na_texts_become_null(spark):
    d = tempfile.mkdtemp(prefix="cg-na-")
    with open(os.path.join(d, "q.csv"), "w") as f:
        f.write("Query,Clicks,Impressions,CTR,Position\nNA,n/a,10,NULL,#N/A\n")
    r = exports.read_exports(spark, d, "queries").first()
    assert r["query"] is None and r["clicks"] is None and r["ctr_raw"] is None and r["position"] is None
    from clickgap.operators import enrich
    e = enrich.parse_query_metrics(exports.read_exports(spark, d, "queries")).first()
    assert e["query_norm"] == "nan" and e["clicks"] == 0.0 and e["position"] is None
