"""The corpus queries that SQL cannot express, on whole given tables, against brute force or held-out labels."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quillwork.llm import packing, registry

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@pytest.fixture(scope="module")
def texts(sf):
    return dict(read(sf, "SELECT doc_id, coalesce(text, '') FROM documents"))


@pytest.fixture(scope="module")
def larger(sf):
    """Tables with more held-out rows, if they are there."""
    beside = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.01")
    return beside if os.path.isdir(beside) else sf


def read(sf, sql):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con.execute(sql).fetchall()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def unseen(sf):
    """Held-out documents whose text no document to learn from has."""
    rows = read(sf, "SELECT doc_id, text FROM documents")
    seen = {t for i, t in rows if not held_out(i)}
    return {i for i, t in rows if held_out(i) and t not in seen}


def test_language_of_held_out_documents(spark, larger):
    got = {r.doc_id: r for r in registry.QUERIES["op2_language_id"](spark, larger).collect()}
    truth = dict(read(larger, "SELECT doc_id, lang FROM documents"))
    assert got.keys() == truth.keys() and all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in got.items())
    asked = [i for i in unseen(larger) if truth[i] is not None and got[i].lang_pred != "und"]
    assert len(asked) >= 20 and np.mean([got[i].lang_pred == truth[i] for i in asked]) >= 0.95


def test_quality_of_held_out_documents(spark, larger):
    got = {r.doc_id: r for r in registry.QUERIES["op9_quality"](spark, larger).collect()}
    truth = dict(read(larger, "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL"))
    assert got.keys() == {i for i, in read(larger, "SELECT doc_id FROM documents")}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    asked = unseen(larger) & truth.keys()
    assert {truth[i] for i in asked} == {0, 1} and np.mean([got[i].predicted == truth[i] for i in asked]) >= 0.95
    good, bad = ([got[i].score for i in asked if truth[i] == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.95


def test_base_secrets(spark, sf, texts):
    got = {r.doc_id: r for r in registry.QUERIES["op3_secrets"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        found = [
            [("assign", m) for m in ASSIGN.finditer(t) if len(m[2]) >= 8],
            [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16],
            [("hex", m) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32],
        ]
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, m in sorted(sum(found, []), key=lambda x: x[1].start())]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found)) and r.base_sha256 == sha(",".join(spans))
        shown = r.spans.split(",") if r.spans else []
        assert [s for s in shown if s in spans] == spans and [int(s.split(":")[1]) for s in shown] == sorted(int(s.split(":")[1]) for s in shown)


def test_base_licences(spark, sf, texts):
    got = {r.doc_id: r for r in registry.QUERIES["op6_licenses"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = [(k, label) for p, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r, at, names = got[i], [k for k, _ in found], {label for _, label in found}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(names)) and names <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_nearest_vectors(spark, sf):
    x = {i: np.array(v, float) for i, v in read(sf, "SELECT vec_id, embedding FROM embeddings") if v and None not in v}
    x = {i: v for i, v in x.items() if np.isfinite(v).all() and v.any()}
    got = defaultdict(list)
    for r in sorted(registry.QUERIES["op7_ann"](spark, sf).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert got.keys() == {i for i in x if i % 50 == 0}
    cosine = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    hits = 0
    for q, found in got.items():
        best = sorted((-cosine(x[q], x[i]), i) for i in x if i != q)[:5]
        assert [k for *_, k in found] == [1, 2, 3, 4, 5] and q not in {i for i, *_ in found}
        assert all(abs(s - cosine(x[q], x[i])) < 1e-12 for i, s, _ in found)
        hits += len({i for i, *_ in found} & {i for _, i in best})
    assert hits / sum(map(len, got.values())) >= 0.9


def test_pieces(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op10_packing"](spark, sf).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for i, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(found))]).tolist()
        assert [o for o, _ in sorted(found)] == ends[:-1] and ends[-1] <= 4096
