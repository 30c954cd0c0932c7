"""The registered queries over the smallest tables: against SQL or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries

TABLES = "documents pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    found = con.execute(queries.oracle_sql()[name])
    kinds = {x[0]: str(x[1]) for x in found.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    at = [list(kinds).index(c) for c in cols]
    assert rows == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_media(spark, sf_dir, texts):
    """All columns again: frames are walked here by the one size formula of this container, sums are taken of the stored bytes."""
    from lodestone.llm import mpeg

    stored = {r.doc_id: bytes(r.media) for r in mpeg.stored(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    kbits = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    for r in queries.op2_mpeg_media(spark, sf_dir).collect():
        raw, media = (texts[r.doc_id].text or "").encode(), stored[r.doc_id]
        want = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        at = 10 + (media[6] << 21 | media[7] << 14 | media[8] << 7 | media[9])
        frames, used, payload = [], set(), b""
        while at < len(media):
            assert media[at : at + 2] in (b"\xff\xfa", b"\xff\xfb")
            kbit = kbits[media[at + 2] >> 4]
            frames.append(at)
            if len(frames) > 1:
                used.add(kbit)
                payload += media[at + 4 + 2 + 17 : at + 144 * kbit * 1000 // 32000]
            at += 144 * kbit * 1000 // 32000
        assert at == len(media) and payload.startswith(want) and not payload[len(want) :].strip(b"\0")
        n, seek = len(frames) - 1, hashlib.sha256(b"".join(x.to_bytes(8, "big") for x in frames[1:])).hexdigest()[:16]
        seconds = Fraction(1152 * n, 32000)
        assert r.feature == f"mpeg(1, 3, 32000);frames={n};seconds={seconds.numerator}/{seconds.denominator};kbit={'-'.join(map(str, sorted(used)))};table=Xing;crc={n}/{n};skipped=0;seek={seek}"


def test_quality(spark, sf_dir, texts):
    got = queries.op4_quadratic_discriminant(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [labels[r.doc_id] == r.predicted for r in got if r.held_out and r.doc_id in labels]
    assert sum(held) / len(held) > 0.9


def test_pii(spark, sf_dir, texts):
    from tests.llm.test_operators import base_spans

    for r in queries.op5_pii_spans(spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id].text)
        said = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]


def test_mix(spark, sf_dir, texts):
    got = queries.op7_sainte_lague_mix(spark, sf_dir).collect()
    by, target = {}, {}
    for r in got:
        assert r["size"] == len((texts[r.doc_id].text or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        by[texts[r.doc_id].source] = by.get(texts[r.doc_id].source, 0) + r.taken
        target[texts[r.doc_id].source] = r.target
    for s, t in target.items():
        assert by[s] == pytest.approx(t, rel=0.02)
    assert sum(target.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))


def test_others_run(spark, sf_dir, texts):
    scores = queries.op8_cross_entropy_difference(spark, sf_dir).collect()
    assert {r.doc_id for r in scores} == set(texts)


def test_repeats(spark, sf_dir, texts):
    from lodestone.llm.chunk_dedup import MIN_WORDS
    from tests.llm.test_operators import chunk_spans

    found = {}
    for r in queries.op10_gear_chunk_dedup(spark, sf_dir).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end, r.keep))
    want = {i: x for i, x in chunk_spans({i: r.text or "" for i, r in texts.items()}, MIN_WORDS).items() if x}
    assert want and {i: sorted(x) for i, x in found.items()} == want


def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline as p
    from lodestone.llm import decontaminate, jaccard_join
    from lodestone.llm.common import scratch

    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before, docs = docs, scratch(stage(spark, docs, sf_dir), f"test-{k}")
        seen.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[: len(columns)] == columns and (docs.columns == columns or k == len(p.STAGES) - 1), name
        assert set(seen[-1]) <= {r.doc_id for r in before.select("doc_id").collect()}
    assert [len(seen[0]) < len(texts), len(seen[1]) < len(seen[0]), len(seen[3]) == len(seen[2])] == [True] * 3
    quality, near, clean, private, mix = seen
    assert all(r == texts[i] for i, r in clean.items())
    grams = lambda t: {tuple(w[k : k + 5]) for w in [t.encode().lower().split()] for k in range(len(w) - 4)} or {tuple(t.split())}
    sets = {i: grams(r.text or "") for i, r in near.items()}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        assert not any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in ids[:k])
    kept = spark.createDataFrame([(i, r.text) for i, r in near.items()], "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.contaminated(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(clean) == set(near) - bad
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", r.text) for r in private.values()) and all(r.n_chars == len(r.text) for r in private.values())
    assert all(0 < r.taken <= 2 * r["size"] for r in mix.values())
    assert {r.doc_id: r.taken for r in p.run(spark, sf_dir).collect()} == {i: r.taken for i, r in mix.items()}
    assert jaccard_join.deduplicated(kept).count() == len(near)
    assert p.STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), sf_dir).agg(F.count("*")).first()[0] == 0


def test_pipeline_of_odd_rows(spark, sf_dir):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, and columns with names that operators use."""
    import corpus_pipeline as p
    from lodestone.llm.common import scratch

    few = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    own = few.collect()
    clash = {"spans": "s", "size": "t", "label": "u", "id": "v", "score": "w", "__id": "x", "_keep": "y", "rep": "z", "target": "t", "flags": "f", "Text2": "g"}
    rows = [tuple(r) for r in own] + [tuple(own[3])] * 3 + [(own[4].doc_id, own[5].text, None, None, None), (None, own[6].text, "en", "a", 5), (None, None, None, None, None), (9001, None, "en", "a", 0), (9002, "", "en", None, 0), (9003, " \n", None, "b", 2), (9004, own[7].text * 200, "en", "a", 9)]
    docs = spark.createDataFrame(rows, few.schema)
    for name, value in clash.items():
        docs = docs.withColumn(name, F.lit(value))
    columns = docs.columns
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.groupBy("doc_id").count().collect()
        docs = scratch(stage(spark, docs, sf_dir), f"odd-{k}")
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns and all(r[c] == v for r in docs.collect() for c, v in clash.items()), name
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before}
        if name == "pii":
            assert {r.doc_id: r["count"] for r in before} == {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert set(docs.columns) == set(columns) | {"source_size", "taken"} and docs.count() > 10
    again = spark.createDataFrame(rows, few.schema).repartition(3)
    for name, value in clash.items():
        again = again.withColumn(name, F.lit(value))
    for _, stage in p.STAGES:
        again = scratch(stage(spark, again, sf_dir), "odd")
    said = lambda df: sorted((str(r.doc_id), r.text or "", r.taken) for r in df.collect())
    assert said(docs) == said(again)
