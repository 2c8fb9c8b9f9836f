"""Analysis fingerprints: key order, blanks and retry settings play no part, everything else does."""

import json

from pyspark.sql import functions as F

from mediaquery.functions import hashing

BASE = {"marlin_recall": {"fps": 2, "q": {"b": [1, {"z": 1, "a": None}], "a": "é\""}}, "gemma_review": {"mode": "deep"}}


def changed(**more):
    out = json.loads(json.dumps(BASE))
    for path, value in more.items():
        section, key = path.split("__")
        out[section][key] = value
    return out


def test_fingerprints(spark):
    def turned(x):
        return {k: turned(v) for k, v in reversed(x.items())} if isinstance(x, dict) else [turned(v) for v in x] if isinstance(x, list) else x

    same = [json.dumps(BASE), json.dumps(turned(BASE), indent=3, ensure_ascii=False), json.dumps(changed(gemma_review__api_max_attempts=9, gemma_review__api_retry_delays_seconds=[1])),
            json.dumps(changed(marlin_recall__segment_overlap_seconds=50))]
    other = [json.dumps(changed(gemma_review__mode="quick")), json.dumps(changed(marlin_recall__q={"a": "é\""})), json.dumps(changed(marlin_recall__fps=3)), "{}", "no json", None]
    rows = [(n, t, d) for d in (100.0, 121.0) for n, t in enumerate(same + other)]
    lit = F.lit
    key = hashing.analysis_fingerprint(F.col("t"), F.col("d"), category=lit("c"), prompt=lit("p"), queries=lit('{"a":1}'), model_id=lit("m"), proxy=lit(None).cast("string"), version=lit("1"))
    got = {(r["n"], r["d"]): r["k"] for r in spark.createDataFrame(rows, "n int, t string, d double").select("n", "d", key.alias("k")).collect()}
    short, long = ([got[n, d] for n in range(len(same + other))] for d in (100.0, 121.0))
    assert len(set(short[:4])) == 1 and len(set(short[3:7])) == 4 and short[7] not in short[:7], "what never changes an analysis, and what does"
    assert short[7] == short[8] == short[9], "no profile at all"
    assert len(set(long[:3])) == 1 and long[3] != long[0] and not set(long) & set(short), "windows count for long videos alone"
    assert spark.range(1).select(hashing.canonical_json(lit(' {"b":[ 1 ,{"z":null,"y":"x"}], "a":true} ')).alias("c")).first()["c"] == '{"a":true,"b":[1,{"y":"x","z":null}]}'
