"""Queries that SQL can't express, against plain restatements in Python on the smallest tables."""

import json
import re
import unicodedata

import pytest

from palisade import queries
from palisade.config import Config
from palisade.functions import catalog
from palisade.operators import models, sfe, tier2
from test_detect import python_pattern, suggested
from test_whole_texts import found as encoded
from test_whole_texts import rewritten

ROLES = [(p, re.I | re.M) for p in catalog.LINE_ROLES] + [(p, re.I) for p in catalog.INLINE_ROLES + catalog.TAG_ROLES + catalog.BRACKET_ROLES]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: (r.t, r.snippet) for r in queries.spliced(spark, sf_dir).collect()}


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def normal(t):
    t = unicodedata.normalize("NFKC", t)
    for a, b in [*catalog.LOOKALIKES.items(), *((c, "") for c in catalog.DROPPED_CHARACTERS), catalog.ELLIPSIS]:
        t = t.replace(a, b)
    return t


def has_role(t):
    return any(re.search(p, t, f) for p, f in ROLES)


def without_roles(t):
    for p, f in ROLES:
        t = re.sub(p, "", t, flags=f)
    return re.sub(r"\s{2,}", " ", t).strip()


def redacted(t, patterns=catalog.PATTERNS, by="[REDACTED]"):
    ids, n = [], 0
    for p in patterns:
        t, k = python_pattern(p).subn(by, t)
        n += k
        ids += [p.id] * bool(k)
    return t, ids, n


def cleaned(t, risk):
    """What the composite sanitizer makes of a text at a risk level, and which methods fired."""
    out = normal(t)
    methods, ids = (["unicode_normalization"] if out != t else []), []
    if risk in ("medium", "high"):
        if has_role(out):
            out, methods = without_roles(out), [*methods, "role_stripping"]
        out, ids, _ = redacted(out, [p for p in catalog.PATTERNS if risk == "high" or p.severity == "high"])
        methods += ["pattern_removal"] * bool(ids)
    if risk == "high" and any(x[-1] for x in encoded(out)):
        out, methods = rewritten(out, lambda x: "[ENCODED DATA]"), [*methods, "encoding_detection"]
    return out, methods, ids


def test_redact_keeping_length(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "redact_keeping_length"):
        assert (r.text, r.patterns_removed, r.replacement_count) == redacted(texts[r.doc_id][0], by=lambda m: "*" * len(m[0]))


def test_nfkc_normalize(spark, sf_dir):
    docs = {r.doc_id: r.t for r in queries.odd(spark, sf_dir).collect()}
    got = {r.doc_id: r.normal for r in run(spark, sf_dir, "nfkc_normalize")}
    assert got == {i: normal(t) for i, t in docs.items()}


def test_analyze_matches(spark, sf_dir, texts):
    got = {}
    for r in run(spark, sf_dir, "analyze_matches"):
        own = got.setdefault(r.doc_id, (r.suggested_risk, r.has_detections, []))
        if r.pattern is not None:
            own[2].append((r.pattern, r.matched, r.position, r.category, r.severity))
    for i, (t, _) in texts.items():
        scan = len(t) >= 3 and any(k in t.lower() for k in catalog.KEYWORDS)
        expect = [(p.id, m[0], m.start(), p.category, p.severity) for p in catalog.PATTERNS for m in python_pattern(p).finditer(t)] if scan else []
        risk, any_, matches = got[i]
        assert matches == expect and risk == suggested(t) and (any_ or not expect)


def test_sanitize_aggressive(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "sanitize_aggressive"):
        out, methods, ids = cleaned(texts[r.doc_id][0], "high")
        assert (r.sanitized, r.methods_applied, r.patterns_removed) == (f"[UD-id]{out}[/UD-id]", [*methods, "boundary_annotation"], ids)


def test_sanitize_methods(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "sanitize_methods"):
        t, ids, _ = redacted(without_roles(texts[r.doc_id][0]))
        assert (r.sanitized, r.methods_applied, r.patterns_removed) == (rewritten(t, lambda x: "[ENCODED DATA]"), ["role_stripping", "pattern_removal", "encoding_detection"], ids)


def test_sentences(spark, sf_dir):
    got = {}
    for r in run(spark, sf_dir, "sentences"):
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence))
    for r in queries.table(spark, sf_dir, "documents").collect():
        assert [s for _, s in sorted(got.get(r.doc_id, []))] == tier2.split_sentences(r.text or "")


def greedy(parts, most):
    """Words to chunks, one sentence at a time."""
    out, used = [], most + 1
    for s in parts:
        n = len(s.split())
        if n > most or used + n > most:
            out.append([])
            used = 0
        out[-1].append(s)
        used = used + n if n <= most else most + 1
    return [" ".join(c) for c in out]


def chunked(t):
    if len(t) < 10:
        return []
    if len(t) + 2 <= 256 or len(t.split()) + 2 <= 256:
        return [t]
    return greedy([s for s in tier2.split_sentences(t) if len(s) >= 10], 254)


def scored(t):
    return min(1.0, len(re.findall("(?i)ignore|system|instructions?|bypass", t)) / 4)


def test_chunk_scores(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "chunk_scores"):
        parts = chunked(texts[r.doc_id][0])
        assert r.skipped == (not parts) and (not parts or (r.chunks, r.score) == (len(parts), max(map(scored, parts))))


def expected_verdict(fields, strings):
    """Of scanned fields ``(name, text)`` and the strings that tier 2 gets, at the default settings."""
    from collections import Counter

    rows = []
    for name, t in fields:
        scan = len(t) >= 3 and any(k in t.lower() for k in catalog.KEYWORDS)
        hits = Counter(p.severity for p in catalog.PATTERNS for _ in python_pattern(p).finditer(t)) if scan else Counter()
        risk = suggested(t)
        level = risk if risk in ("high", "critical") else "medium"
        rows.append((name, t, sum(hits.values()), risk, level))
    n = max(len(rows), 1)
    high = sum(h > 0 and r in ("high", "critical") for _, _, h, r, _ in rows)
    medium = sum(h > 0 and r == "medium" for _, _, h, r, _ in rows)
    hits = sum(h for _, _, h, _, _ in rows)
    up = high >= 1 or (medium >= 3 and medium / n >= 0.25) or (hits >= 3 and hits / n >= 0.25)
    touched, detections = [], []
    for name, t, _, _, level in rows:
        _, methods, ids = cleaned(t, level) if level != "critical" else ("", [], [])
        if {"role_stripping", "pattern_removal", "encoding_detection"} & set(methods):
            touched.append(name)
        detections += [i for i in ids if i not in detections]
    best = [max(map(scored, c)) for c in map(chunked, strings) if c]
    top = max(best, default=None)
    strong = sum(b >= 0.75 for b in best)
    effective = top * (strong / len(best)) ** 0.1 if top is not None and len(best) > 2 and strong else top
    rank = max(2 if up else 1, 0 if effective is None else 2 if effective >= 0.8 else 1 if effective >= 0.5 else 0)
    return ("low", "medium", "high", "critical")[rank], "|".join(detections), "|".join(touched), top


def test_verdict(spark, sf_dir, texts):
    fields = Config().risky_fields
    for r in run(spark, sf_dir, "verdict"):
        t, snippet = texts[r.payload_id]
        scanned = [(n, x) for n, x in (("subject", snippet), ("body", t)) if fields.risky(n, r.tool_name)]
        strings = [x for _, x in scanned] or [snippet, t, str(r.payload_id)]
        risk, detections, touched, top = expected_verdict(scanned, strings)
        assert (r.risk_level, r.detections, r.fields_sanitized, r.tier2_score) == (risk, detections, touched, top), r.payload_id
        assert r.allowed  # nothing is blocked by default


def test_conversation_turns_as_payloads(spark, sf_dir):
    rows = {r.conv_id * 1000 + r.turn: f"{r.role}: {r.text}" for r in queries.table(spark, sf_dir, "conversations").collect() if r.role is not None and r.text is not None}
    got = {r.payload_id: r for r in run(spark, sf_dir, "conversation_turns_as_payloads")}
    assert len(rows) > 50
    for i, t in rows.items():
        risk, _, touched, _ = expected_verdict([("message", t)], [])
        assert (got[i].risk_level, got[i].fields_sanitized, got[i].strings) == (risk, touched, 1)


def test_all_queries_have_a_comparison():
    named = {k.removeprefix("test_") for k in globals() if k.startswith("test_")}
    assert set(queries.QUERIES) - set(queries.ORACLE) <= named


def test_shared_models(spark):
    """A shared factory runs once in a process, from any number of tasks, and again after a failure."""
    made = []
    one = models.Shared(("test", 1), lambda: made.append(1) or object())
    assert not one.is_loaded() and one() is one() and made == [1] and one.is_loaded()
    bad = models.Shared(("test", 2), lambda: 1 / 0)
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            bad()
    assert models.warm(spark, one) == spark.sparkContext.defaultParallelism and models.warm(spark, bad) == 0


def test_trained_predictor(spark):
    class Model:
        def predict(self, texts, k):
            return [[f"{sfe.LABEL_PREFIX}{'drop' if ' uuid ' in t else 'pass'}"] for t in texts], [[0.9] for _ in texts]

    make = sfe.trained_predictor("a file", lambda path: Model())
    df = spark.createDataFrame([(json.dumps({"uuid": "u", "name": "n"}),)], "payload string")
    r = sfe.sfe_filter(df, make).first()
    assert json.loads(r.payload) == {"name": "n"} and r.fields_dropped == ["uuid"] and not r.sfe_failed
    assert sfe.sfe_filter(df, sfe.trained_predictor("no such file")).first().sfe_failed


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (10, 5000, 20, 30, 9000)])], ["t"])
    parts = list(models.pieces(iter([batch, batch.slice(0, 0)]), 6000))
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist() and all(p.nbytes <= 6000 or p.num_rows == 1 for p in parts)


def test_lifecycle(spark):
    import palisade

    d = palisade.create_defense(scorer=tier2.WordScorer)
    assert d.warmup(spark) and d.is_loaded() and d.get_config()["tier2"]["min_text_length"] == 10
    assert not palisade.create_defense().is_loaded()
