import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from focuslake.llm import lm
from focuslake.llm.lm import Code, Learner, Model, _entry, scores
from focuslake.llm.words import slices

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w] + [None]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.mark.parametrize("hot", [lm.HOT, 3, 0])
def test_base_equals_brute_force(spark, documents, odd, prose, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    rows = odd + [(100 + i, prose(30, i).upper() + (" Rare%d" % i)) for i in range(40)]
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, floor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    want = sorted(((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n) for i, t in rows), key=repr)
    got = lm.scores(documents(rows, extra=True), str(tmp_path / "lm")).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=repr) == want
    base = sorted(((i is None, i or 0, sum(math.log10((c[w] + 0.5) / floor) for w in tokens(t))) for i, t in rows))
    assert np.allclose([b for *_, b in base], [b for *_, b in sorted((r.doc_id is None, r.doc_id or 0, r.base_score) for r in got)])
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert len({r.score for r in got if not r.n_bytes}) == 1


def test_empty_table_and_no_training_texts(spark, documents, tmp_path):
    assert scores(documents([]), str(tmp_path / "a")).collect() == []
    only = next(i for i in range(100) if held(i))
    row = scores(documents([(only, "a b")]), str(tmp_path / "b")).first()
    assert (row.n_known, row.train_tokens) == (0, 0) and row.base_score == 0 and row.score < 0


def model_of(text, times=1):
    signs = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=257) + 0
    signs[256] = 1
    code = Code(signs)
    learner = Learner(code)
    for _ in range(times):
        for s in slices(pa.array([text])):
            learner.learn(s)
    tables = [_entry(*c.astype(float).reshape(-1, 2).T) for c in learner.counts]
    return Model(code, tables, learner.weights, learner.refined)


def score(model, texts):
    return np.concatenate([model.score(s) for s in slices(pa.array(texts), 64)])


def test_probabilities_of_the_next_byte_add_up(prose):
    """Every prefix-free end: a text, and all its continuations by one more sign, share its probability."""
    model = model_of(prose(300, 1))
    code = model.code
    assert abs(sum(2.0 ** -n for n in code.length) - 1) < 1e-12     # a full code, so decisions split all of it
    # One decision and its opposite add up to one: score both bits of every node in a fixed context.
    text, total = "bala", 0.0
    prefix = score(model, [text])[0]
    seen = []
    for b in range(256):
        raw = text.encode() + bytes([b])
        s = next(slices(pa.array([raw], pa.binary())))
        d = lm.Distinct(s)
        owner, node, bit = d.decisions(code)
        looked = [t[slot] for t, slot in zip(model.tables, d.slots(owner, node))]
        gate = lm.gates(code.depth[node], [x & 3 for x in looked])
        mixed = np.clip(sum(model.weights[k][gate] * (x >> 2) for k, x in enumerate(looked)), -12, 12)
        logit = (mixed + model.refined[node * lm._BUCKETS + lm._bucket(mixed)]) * (0.5 - bit)
        cost = np.bincount(owner, weights=np.log1p(np.exp(logit)), minlength=len(d.symbol))
        seen.append(math.exp(-cost[d.of[4]]))
    end = math.exp(prefix * math.log(10) + sum_before(model, text))
    assert abs(sum(seen) + end - 1) < 1e-4


def sum_before(model, text):
    """Cost in nats of a text without its end."""
    s = next(slices(pa.array([text])))
    d = lm.Distinct(s)
    owner, node, bit = d.decisions(model.code)
    looked = [t[slot] for t, slot in zip(model.tables, d.slots(owner, node))]
    gate = lm.gates(model.code.depth[node], [x & 3 for x in looked])
    mixed = np.clip(sum(model.weights[k][gate] * (x >> 2) for k, x in enumerate(looked)), -12, 12)
    logit = (mixed + model.refined[node * lm._BUCKETS + lm._bucket(mixed)]) * (0.5 - bit)
    cost = np.bincount(owner, weights=np.log1p(np.exp(logit)), minlength=len(d.symbol))
    return cost[d.of[:-1]].sum()


def test_learns_and_does_not_depend_on_slices(prose):
    text = prose(4000, 1)
    known, new = prose(200, 5), "qzxv wwkj " * 120
    model = model_of(text, 3)
    a, b = score(model, [known, new])
    assert -a / len(known) < 0.55 * -b / len(new) and -a / math.log10(2) / len(known) < 2.2
    each = [score(model, [t])[0] for t in (known, new, "", "a")]
    assert np.allclose(score(model, [known, new, "", "a"]), each, rtol=1e-6)


def test_every_decision_of_the_training_text_moves_weights_and_refinement(prose):
    text = prose(300, 1)
    code = Code(np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=257))
    learner = Learner(code)
    for _ in range(2):
        for s in slices(pa.array([text, "other text"])):
            learner.learn(s)
    decisions = 2 * sum(int(code.length[list(t.encode()) + [256]].sum()) for t in (text, "other text"))
    assert learner.bits == decisions and learner.refined.sum() == decisions
