import os
import tempfile

from clickgap.config import Config
from clickgap.streaming import incremental as S


def test_enrichment_runs_on_a_stream(spark):
    src = tempfile.mkdtemp(prefix="cg-stream-src-")
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("query,clicks,impressions,ctr_raw,position\nBuy Acme shoes,5,100,5%,2\nhow to tie,1,10,,12\n")
    out = tempfile.mkdtemp(prefix="cg-stream-out-")
    ck = tempfile.mkdtemp(prefix="cg-stream-ck-")
    q = S.start_enrichment(S.stream_queries(spark, src), Config(brand_terms=("acme",)),
                           os.path.join(out, "data"), ck, trigger_once=True)
    q.awaitTermination(120)
    rows = {r["query_norm"]: r for r in spark.read.parquet(os.path.join(out, "data")).collect()}
    assert rows["buy acme shoes"]["segment"] == "Branded - transactional"
    assert rows["how to tie"]["intent"] == "informational"
    assert abs(rows["how to tie"]["ctr"] - 0.1) < 1e-12
