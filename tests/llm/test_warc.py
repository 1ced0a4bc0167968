import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from obsengine.llm import warc
from obsengine.llm.common import staging_path


def want(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, p in data:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in data:
        f = first.get(p) if len(p) >= least else None
        revisit = f is not None and f != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


def test_url_keys(spark):
    urls = {
        "https://www.Example.com/A?b=C#d": "com,example,www)/A?b=C",
        "http://u:p@example.com:8080": "com,example:8080)/",
        "http://example.com?q": "com,example)/?q",
        "no scheme": ")no scheme",
        None: ")",
        "": ")",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.url_key(F.col("url")).alias("key"))
    assert dict(map(tuple, df.collect())) == urls


@pytest.mark.parametrize("refers_to", [None, 0, -5])
def test_records(refers_to):
    payload = "é\r\n\r\n<p>".encode()
    data = warc.record(7, "http://x/ü\n ", payload, warc.base32_sha1(payload), refers_to)
    kind = "response" if refers_to is None else "revisit"
    assert warc.parse(data) == (7, "http://x/ü\n ", kind, warc.base32_sha1(payload), len(payload), refers_to, payload if refers_to is None else None)
    if refers_to is None:
        with pytest.raises(ValueError):
            warc.parse(data.replace(b"<p>", b"<q>"))


def pages(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randint(0, 3)}.com/{rng.randint(0, 400)}", "p" * rng.randint(0, 5)) for i in range(1500)]
    rows += [(-3, None, None), (None, "http://a.b/", ""), (None, None, "only null ids"), (5000, "", "é" * 300_000), (5001, "x y\tz", "1"), (-9, "http://h1.com/1", "uniq")]
    rows += [rows[3], rows[3], (rows[3][0], rows[3][1], "another payload")]
    return rows, spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, key string, offset int")


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows, df = pages(spark)
    assert sorted(map(tuple, warc.round_trip(df.repartition(5), least).collect()), key=repr) == want(rows, least)


def test_lookup_of_some_and_of_missing_keys(spark):
    rows, df = pages(spark)
    archives, index = staging_path(spark, "archives"), staging_path(spark, "index")
    shards = warc.write_index(warc.write_archives(df, archives), index)
    keyed = df.select(warc.url_key(F.col("url")).alias("key"), "page_id", "url", "html")
    asked = keyed.filter("page_id % 50 = 0").select("key", "page_id")
    asked = asked.union(spark.createDataFrame([("zzz)/", 1), ("", None), ("com,h1)/1", 10**9)], "key string, page_id long"))
    got = warc.fetch(warc.lookup(asked, index, shards), archives).collect()
    by = {r.page_id: r for r in got}
    chosen = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    assert len(got) == len(chosen) and all(by[i].url == u for i, u, _ in chosen)
    assert all(bytes(r.payload).decode() == (dict((i, h) for i, _, h in chosen)[r.page_id] or "") for r in got if r.record_type == "response")


def test_no_pages(spark):
    assert warc.round_trip(pages(spark)[1].limit(0)).count() == 0
