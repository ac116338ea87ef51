"""Synonym noise replaces whole spans by entries of a lexicon, in a language of choice."""

import hashlib
import re

import duckdb

from glossmill.plans import registry
from glossmill.plans.bound_operators import SYNONYMS

SF = "/root/testdata/sf0.001"


def brute(item, text, target):
    lexicon = {w: s for w, mono, multi in SYNONYMS if (s := mono if target == "mono" else multi)}
    words, out, n, i, at = text.split(" "), [], 0, 0, 0
    core = [re.sub(r"[.,;:!?)\]]+$", "", w) for w in words]
    while i < len(words):
        k = 2 if i + 1 < len(words) and f"{words[i]} {core[i + 1]}".lower() in lexicon else 1
        phrase = f"{words[i]} {core[i + 1]}".lower() if k == 2 else core[i].lower()
        if phrase in lexicon and int(hashlib.md5(f"3:{target}:{item}:{at}".encode()).hexdigest()[:8], 16) < 1288490188:
            out.append(lexicon[phrase] + words[i + k - 1][len(core[i + k - 1]) :])
            n += 1
        else:
            k = k if phrase in lexicon else 1
            out += words[i : i + k]
        at += sum(len(w) + 1 for w in words[i : i + k])
        i += k
    return " ".join(out), n


def test_spans_are_replaced_by_the_lexicon(spark):
    texts = duckdb.sql(f"SELECT item_id, regexp_replace(text, '\\s', ' ', 'g') FROM '{SF}/benchmark.parquet' WHERE text IS NOT NULL").fetchall()
    want = {(i, target): brute(i, t, target) for i, t in texts for target in ("mono", "multi")}
    got = {(r["item_id"], r["target"]): (r["noisy"], r["n_noise"]) for r in registry.queries()["noise_synonym"](spark, SF).collect()}
    assert got == want and sum(n for _, n in got.values()) > 0
    assert any(a != want[i, "multi"] for (i, t), a in want.items() if t == "mono")


def test_phrases_do_not_overlap():
    phrases = [w.split() for w, _, _ in SYNONYMS if " " in w]
    assert all(len(p) == 2 for p in phrases) and not {p[0] for p in phrases} & {p[1] for p in phrases}
