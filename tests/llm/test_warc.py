import base64
import gzip
import hashlib
import io
import random
import tempfile

from pyspark.sql import functions as F

from parlance.llm import warc as W
from parlance.llm.catalog import oracle_sql, queries
from tests_llm_sql import rows, sql_rows


def brute(pages):
    groups = {}
    for i, (pid, _, html) in enumerate(pages):
        groups.setdefault((html or "").encode(), []).append(i)
    out = {}
    for payload, rows in groups.items():
        top = max(rows, key=lambda i: pages[i][0])
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in rows:
            out[pages[i][0]] = (len(payload), digest, "response" if i == top else "revisit", None if i == top else pages[top][0])
    return out


def test_query_is_brute_force_on_the_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries()["op8_warc_round_trip"](spark, sf).collect()
    assert len(got) == len(pages)
    assert {r["page_id"]: tuple(r)[1:] for r in got} == brute(pages)


def write(spark, pages, **options):
    path = tempfile.mkdtemp(prefix="spark-") + "/warc"
    W.register(spark)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    W.page_records(df).write.format("warc").options(path=path, **options).mode("append").save()
    return path


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows(queries()["op8_warc_round_trip"](spark, sf).withColumn("refers_to", F.coalesce("refers_to", F.lit(-1))))
    want = f"SELECT * REPLACE (coalesce(refers_to, -1) AS refers_to) FROM ({oracle_sql()['op8_warc_round_trip']})"
    assert got == sql_rows(want, sf) and len(got) > 0


def test_odd_rows_and_files(spark):
    pages = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://ü/\r\nX: y", None), (4, "u", ""), (5, "u", "é𝔘\r\n\r\nWARC/1.0\r\n"),
             (6, "u", "z" * 3_000_000), (7, "a", "t"), (7, "b", "t"), (None, "n", "t"), (None, "n", "alone")]
    path = write(spark, pages, filebytes="10")
    got = {(r["record_id"], r["record_type"]): r for r in W.read_warc(spark, path, splitbytes="100").collect()}
    assert len(got) == 10
    kind = lambda n: sorted(t for i, t in got if i == f"<urn:page:{n}>")
    assert kind(1) == ["revisit"] and kind(2) == ["response"] and kind(7) == ["response", "revisit"] and kind("none") == ["response", "revisit"]
    assert got["<urn:page:1>", "revisit"]["refers_to"] == "<urn:page:2>" and got["<urn:page:3>", "revisit"]["refers_to"] == "<urn:page:4>"
    assert bytes(got["<urn:page:5>", "response"]["payload"]).decode() == pages[4][2]
    assert len(got["<urn:page:6>", "response"]["payload"]) == 3_000_000
    assert got["<urn:page:3>", "revisit"]["target_uri"] == "http://ü/%0D%0AX: y" and "X" not in got["<urn:page:3>", "revisit"]["headers"]
    assert W.read_warc(spark, write(spark, [])).count() == 0


def test_predicates_are_pushed_and_payloads_not_decoded(spark):
    rng = random.Random(1)
    pages = [(i, f"http://h{i % 3}/", str(rng.randint(0, 40))) for i in range(200)]
    path = write(spark, pages)
    df = W.read_warc(spark, path)
    some = df.filter((F.col("record_type") == "response") & F.col("target_uri").isin("http://h0/", "http://h1/"))
    assert some.count() == df.filter(F.col("record_type") == "response").collect().__len__() - df.filter(
        "record_type = 'response' and target_uri = 'http://h2/'").count()
    reader = W.WarcReader({"path": path})
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.EqualTo(("headers",), 1), W.In(("target_uri",), ("http://h0/",))]))
    assert len(left) == 1 and len(reader.tests) == 2
    calls = []
    old, W.digest_of = W.digest_of, lambda p: calls.append(p) or old(p)
    try:
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    finally:
        W.digest_of = old
    assert not calls and rows and all(r["record_type"] == "revisit" and r["target_uri"] == "http://h0/" for r in rows)
    none = W.read_warc(spark, path, payload="false")
    assert none.count() == 200 and none.filter("payload is not null").count() == 0


def test_archives_of_others():
    """Without skip lengths, and without compression; skipped and read records alternate."""
    one = lambda i: (f"WARC/1.0\r\nWARC-Type: {'resource' if i % 2 else 'metadata'}\r\nWARC-Record-ID: <r{i}>\r\n"  # noqa: E731
                     f"Content-Length: {100_000 * (i % 3)}\r\n\r\n").encode() + b"p" * (100_000 * (i % 3)) + b"\r\n\r\n"
    plain = b"".join(map(one, range(9)))
    zipped = b"".join(gzip.compress(one(i)) for i in range(9))
    own = b"".join(W.encode_record({"WARC-Type": "resource" if i % 2 else "metadata", "WARC-Record-ID": f"<r{i}>"}, b"p" * (100_000 * (i % 3))) for i in range(9))
    assert gzip.decompress(own).count(b"WARC/1.1") == 9
    for data in (plain, zipped, own):
        got = list(W.records(io.BytesIO(data), lambda h: h["WARC-Type"] == "resource"))
        assert [r[0] for r in got] == ["<r1>", "<r3>", "<r5>", "<r7>"]
        assert [len(r[-1]) for r in got] == [100_000, 0, 200_000, 100_000]
        assert len(list(W.records(io.BytesIO(data), lambda h: True, decode=False))) == 9
