"""Each stage against a brute-force version of it, over its own input."""

import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from glossmill.llm import langid, quality

SF = "/root/testdata/sf0.001"
WORDS = "the river ran past a mill where an old clerk copied letters for people who could not write them and sold ink".split()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows, columns) of each stage over documents with odd rows beside them."""
    at = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(WORDS[i * i % len(WORDS)] + str(i % 7) for i in range(400))
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "1234 5678", None, "s", 9), (9004, long, "en", "s", len(long)), (9005, long, "en", "s", len(long)), (9006, long.replace("mill", "barn", 1), None, "s", len(long)), (9007, "Short text " + long[:300], "en", "s", 311)]
    docs.union(spark.createDataFrame(odd, docs.schema)).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    out, now = [], spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in pipeline.STAGES:
        then = pipeline.store(stage(spark, now, at))
        out.append((name, now, then, at))
        now = then
    return {name: (a, b, at) for name, a, b, at in out}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_order(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert list(stages) == ["quality_classifier", "language_id", "jaccard_join", "suffix_dedup", "packing"]
    assert all(b.columns == columns for name, (_, b, _) in stages.items() if name != "packing")


def plain_score(net, text):
    """One chunk and one filter place after another, in plain sums."""
    raw = (text or "").encode()
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-(len(raw) - quality.OVERLAP) // step))
    raw += bytes(n * step + quality.OVERLAP - len(raw))
    pooled = []
    for c in range(n):
        own = list(raw[c * step : c * step + quality.CHUNK])
        acts = [sum(net.w["E"][k, own[p + k]].astype(float) for k in range(quality.WIDTH)) for p in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
        pooled.append(np.tanh(np.max(acts, axis=0) * 0.5 + net.w["b"]))
    z = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0), np.min(pooled, axis=0)])
    return float(1 / (1 + np.exp(-(np.maximum(z @ net.w["H"] + net.w["h"], 0) @ net.w["o"] + net.w["c"][0]))))


def test_quality_stage(spark, stages):
    a, b, at = stages["quality_classifier"]
    net = quality.fit(a, spark.read.parquet(f"{at}/labels.parquet"))
    kept, scores = texts(b), {k: plain_score(net, t) for k, t in texts(a).items()}
    for k, t in texts(a).items():
        assert (k in kept) == (scores[k] >= pipeline.LEAST_QUALITY) or abs(scores[k] - pipeline.LEAST_QUALITY) < 1e-4
        assert k not in kept or kept[k] == t
    assert 0 < b.count() < a.count()


def test_language_stage(stages):
    a, b, _ = stages["language_id"]
    assert texts(b) == {k: t for k, t in texts(a).items() if re.search(r"[^\W\d_]", t or "")}
    profiles = langid.fit(a)
    assert all(profiles.predict(t)[0] in profiles.languages for t in texts(b).values())


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicate_stage(stages):
    a, b, _ = stages["jaccard_join"]
    sets = {k: shingles(t) for k, t in texts(a).items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in sets:
        for y in sets:
            if x < y and sets[x] and 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y]):
                i, j = sorted((find(x), find(y)))
                root[j] = i
    assert texts(b) == {k: t for k, t in texts(a).items() if find(k) == k}
    assert not {9005, 9006} & set(texts(b)) or 9004 not in texts(a)


def test_repeats_stage(stages):
    a, b, _ = stages["suffix_dedup"]
    seen, want = set(), {}
    for k, t in sorted(texts(a).items()):
        raw = (t or "").encode()
        own = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + 50] = True
        want[k] = bytes(np.frombuffer(raw, np.uint8)[~gone])
        seen.update(own)
    got = {r["doc_id"]: r for r in b.collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        kept = want[k].decode("utf-8", "replace")
        assert "\ufffd" in kept or (r["text"] or "") == kept
        assert r["n_chars"] in (None, len(r["text"] or ""))


def test_packing_stage(stages):
    a, b, _ = stages["packing"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = b.collect()
    for k, t in texts(a).items():
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
