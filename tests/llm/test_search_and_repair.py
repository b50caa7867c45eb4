"""Importance resampling, decontamination and conversation repair against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tactica.llm import conversations, decontamination, resampling, words

SMALL = "/root/testdata/sf0.001"
PASSAGE = "the quick brown fox jumps over the lazy dog while the sleepy cat watches"
AWKWARD = [
    (1, PASSAGE), (2, f"Before it. {PASSAGE.upper()}! And after; {PASSAGE}"), (3, None), (4, ""), (5, " .,;\t\n"), (6, "word"), (7, PASSAGE), (7, PASSAGE), (None, f"no id at all {PASSAGE}"),
    (None, "no id again"), (9, "ünïcödé 中文 😀 ΑΣ ½² Ünïcödé"), (10, "x" * 50_000), (11, "long tail " * 8_000), (12, "dog lazy the over jumps fox brown quick the while sleepy the cat watches"),
    (13, "the quick brown fox jumps over the"), (14, "short item here"), (15, " ".join(f"w{i}" for i in range(40))),
]
SCHEMA = "doc_id long, text string, words array<string>, shard long, id string, row_key string, place string, rank int, n_words string"
ITEMS = [(0, PASSAGE), (1, "short item here"), (2, None), (3, ""), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (5, PASSAGE), (6, "ünïcödé 中文"), (6, "word"), (7, "long tail " * 6)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, ties, repeats, long texts, and columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, ["a"], 1, "i", "k", "p", 2, "n") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", ["y"], 3) for i, t in ITEMS], "item_id long, text string, item string, words array<string>, k int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_items(spark):
    return spark.createDataFrame([], "item_id long, text string")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_words(t):
    return [w for w in re.split(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()) if w]


def key(x):
    return (x is None, x or 0)


def test_words_of_a_batch():
    rows = ["", "One, two", "two", "...", "Éa b", "x", "", "a  b"]
    for first, last in ((0, 8), (1, 5), (2, 2), (6, 7)):
        w = words.split(pa.array(rows).slice(first, last - first))
        want = [(k, x) for k, t in enumerate(rows[first:last]) for x in plain_words(t)]
        got = [(int(d), w.line[s : s + n].tobytes()) for d, s, n in zip(w.doc, w.start, w.length, strict=True)]
        assert got == want and [w.distinct[int(c)].as_py() for c in w.code] == [x for _, x in want] and w.counts().tolist() == [len(plain_words(t)) for t in rows[first:last]]
    batch = pa.record_batch({"text": pa.array(["a" * 30, "b", "c" * 5, "", "d" * 5])})
    assert [p["text"].to_pylist() for p in words.portions(batch, "text", 10)] == [["a" * 30], ["b", "c" * 5, ""], ["d" * 5]]


# --- importance resampling ------------------------------------------------------------------------


def plain_importance(rows, target):
    def features(t):
        w = plain_words(t)
        return [zlib.crc32(x) % 10_000 for x in [*w, *(a + b" " + b for a, b in itertools.pairwise(w))]]

    s, t = (Counter(b for x in part for b in features(x)) for part in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], key(r[0]), r[2], r[1]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("table", "target"), [("docs", "benchmark"), ("awkward", "items"), ("empty", "items"), ("docs", "no_items"), ("empty", "no_items")])
def test_importance(request, table, target):
    df, goal = request.getfixturevalue(table), request.getfixturevalue(target)
    got = resampling.draw(resampling.importance(df.repartition(3), goal)).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got) == plain_importance(texts(df), [r.text for r in goal.collect()])


def test_drawn_rows_keep_their_columns(spark, docs, benchmark, awkward, items):
    for df, goal in ((docs, benchmark), (awkward, items)):
        want = plain_importance(texts(df), [r.text for r in goal.collect()])
        got = resampling.resample(df, goal)
        assert got.columns == df.columns and Counter(r.doc_id for r in got.collect()) == Counter(k[0] for k in want.elements() if k[4] is not None)


def test_draw_settles_ties_by_id(spark):
    scored = spark.createDataFrame([(i, 1, 5, 5 if i % 2 else 6, 30 if i != 1 else 3) for i in range(40)], "doc_id long, n_features long, weight long, score long, n_words long")
    got = {r.doc_id: r["rank"] for r in resampling.draw(scored.repartition(4), percent=60).collect()}
    order = [*range(0, 40, 2), *range(3, 40, 2)]
    assert got == {i: order.index(i) + 1 if i != 1 and order.index(i) < 60 * 39 // 100 else None for i in range(40)}


def test_checksums_by_length():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, n, np.uint8) for n in [0, 1, 1, 2, 5, 5, 5, 256, 257, 1000, 0]]
    length = np.array([len(p) for p in parts])
    start = np.cumsum(length) - length
    got = resampling.crc32(np.concatenate(parts), start, length)
    assert got.tolist() == [zlib.crc32(p.tobytes()) for p in parts]


# --- decontamination ------------------------------------------------------------------------------


def plain_contamination(rows, items, size=10, reach=20):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = plain_words(t)
        hit, found, near = set(), set(), set()
        places = {}
        for p, x in enumerate(w):
            places.setdefault(x, []).append(p)
        for win, owners in windows.items():
            for p in places.get(win[0], ()):
                if tuple(w[p : p + len(win)]) == win:
                    hit.update(range(p, p + len(win)))
                    found |= owners
            if all(x in places for x in win) and not owners <= near:
                rarest = min(set(win), key=lambda x: len(places[x]))
                if any(set(win) <= set(w[s : s + reach]) for p in places[rarest] for s in range(max(0, p - reach + 1), p + 1)):
                    near |= owners
        out.append((i, len(w), len(hit), tuple(sorted(found)), tuple(sorted(near))))
    return Counter(out)


@pytest.mark.parametrize(("table", "goal"), [("docs", "benchmark"), ("awkward", "items"), ("empty", "items"), ("docs", "no_items")])
@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(request, table, goal, block_bytes):
    """Also where the phrases come in many blocks."""
    df, bench = request.getfixturevalue(table), request.getfixturevalue(goal)
    if goal == "benchmark" and block_bytes == 300:
        bench, df = bench.limit(4), df.limit(60)
    rows, marks = texts(df), [(r.item_id, r.text) for r in bench.collect()]
    got = decontamination.contamination(df.repartition(3), bench, block_bytes=block_bytes).collect()
    assert Counter((r.id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"]), tuple(r.near_items)) for r in got) == plain_contamination(rows, marks)
    assert all(a.end < b.start for r in got for a, b in itertools.pairwise(r.spans))


def test_phrases_of_many_places(monkeypatch):
    """More candidate places than are intersected at a time, in several texts of a shard."""
    monkeypatch.setattr(decontamination, "CANDIDATES", 50)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60)))) for i in range(40)]
    marks = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(3, 14)))) for i in range(30)]
    w = words.split(pa.array([t for _, t in rows]))
    place = np.argsort(w.code, kind="stable").astype(np.int32)
    counts = np.bincount(w.code).astype(np.int32)
    steps = np.diff(place, prepend=np.int32(0)).astype(np.int32)
    firsts = np.cumsum(counts) - counts
    steps[firsts] = place[firsts]
    shard = decontamination.Shard(np.r_[0, np.cumsum(w.counts())].astype(np.int32).tobytes(), w.distinct.cast(pa.binary()), counts.tobytes(), steps.tobytes())
    phrases = sorted({tuple(x.decode() for x in plain_words(t)[k : k + 5]) for _, t in marks for k in range(max(1, len(plain_words(t)) - 4))})
    block = decontamination.Block([list(p) for p in phrases], [["i"]] * len(phrases))
    phrase, start, length, _, _ = shard.find(block, 7)
    doc = shard.doc(start)
    got = {(int(d), int(s - shard.starts[d]), int(p), int(n)) for d, s, p, n in zip(doc, start, phrase, length, strict=True)}
    want = set()
    for d, (_, t) in enumerate(rows):
        x = [y.decode() for y in plain_words(t)]
        want |= {(d, s, k, len(p)) for k, p in enumerate(phrases) for s in range(len(x)) if tuple(x[s : s + len(p)]) == p}
    assert got == want and want


# --- conversation repair --------------------------------------------------------------------------


def initial(role):
    return role[:1]


def plain_repair(rows):
    """(cost, audit, lines) of the best repair of (role, text, fault): all ways, cheapest first, by recursion on suffixes."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {}

    def solve(i, last, room):
        if (i, last, room) not in best:
            options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
            if i < len(rows):
                role, text, fault = rows[i]
                c, a, x = solve(i + 1, last, 3)
                options.append((c + 3, "D" + a, x))
                if fault not in ("blank", "duplicate"):
                    more = fault == "truncated"
                    if role and initial(role) in follow[last]:
                        c, a, x = solve(i + 1, initial(role), 3)
                        options.append((c + more, "K" + a, (f"{role}:{text}", *x)))
                    for new in ("user", "assistant"):
                        if new[0] in follow[last]:
                            c, a, x = solve(i + 1, new[0], 3)
                            options.append((c + 2 + more, "R" + a, (f"{new}:{text}", *x)))
            if room:
                for new in ("user", "assistant"):
                    if new[0] in follow[last]:
                        c, a, x = solve(i, new[0], room - 1)
                        options.append((c + 2, "I" + a, (f"{new}:", *x)))
            best[i, last, room] = min(options, default=(10**9, "", ()))
        return best[i, last, room]

    return solve(0, "", 3)


def plain_audit(rows):
    """rows: (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marked, seen, faults, turns = [], set(), Counter(), [t for t, _, _ in rows if t is not None]
    for _, role, text in rows:
        body = text.strip("\t\n\x0b\x0c\r ")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        marked.append((role, text, fault))
    cost, audit, lines = plain_repair(marked)
    illegal = sum(initial(a[0]) + initial(b[0]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def told(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


def random_rows(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None, "a"]
    said = ["Yes.", "No!", "cut off", "", "  \n", "same.", "same.", None, "Ünïcödé 😀?", "ends.  \t"]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(said)) for _ in range(n)]


def test_repair_of_random_conversations(spark):
    rng = random.Random(9)
    convs = {i if i else None: random_rows(rng, rng.randrange(1, 14)) for i in range(150)}
    rows = [(c, *r, "x", True, 1) for c, part in convs.items() for r in part]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, again boolean, fault int").repartition(5)
    got = told(conversations.audit(df).collect())
    assert got == {c: plain_audit(part) for c, part in convs.items()}
    whole = {}
    for r in sorted(conversations.repair(df).collect(), key=lambda r: (key(r.conv_id), r.position)):
        whole.setdefault(r.conv_id, []).append(r)
    for c in convs:
        lines = whole.get(c, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(initial(r.role) for r in lines)) and [r.position for r in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in lines).encode()).hexdigest() == got[c][-1]
        assert [r.edit for r in lines] == [e for e in got[c][6] if e != "D"] and all((r.turn is None) >= (r.edit == "I") for r in lines)


def test_no_cheaper_repair_exists():
    """The recursion, and so the operator, against every sequence of edits with few insertions."""
    rng = random.Random(2)
    for _ in range(60):
        rows = [(r or " ", x or " ", rng.choice(["", "", "truncated", "blank"])) for _, r, x in random_rows(rng, 3)]
        found = []
        for puts in itertools.product(range(3), repeat=4):
            for edits in itertools.product("DKua", repeat=3):
                roles, cost, audit, ok = "", 0, "", True
                for k in range(4):
                    for _ in range(puts[k]):
                        new = "a" if roles[-1:] == "u" else "u"
                        roles, cost, audit = roles + new, cost + 2, audit + "I"
                    if k < 3:
                        role, _, fault = rows[k]
                        if edits[k] == "D":
                            cost, audit = cost + 3, audit + "D"
                        else:
                            ok &= fault != "blank"
                            cost += (fault == "truncated") + (0 if edits[k] == "K" else 2)
                            roles, audit = roles + (initial(role) if edits[k] == "K" else edits[k]), audit + ("K" if edits[k] == "K" else "R")
                if ok and re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
        assert min(found) == plain_repair(rows)[:2]


def test_giant_conversations_spill(monkeypatch):
    monkeypatch.setattr(conversations, "HELD", 500)
    rng = random.Random(4)
    rows = [(i, r or " ", f"{x or ''}{i}.") for i, (_, r, x) in enumerate(random_rows(rng, 400))]
    c = conversations.Conversation("c")
    for turn, role, text in reversed(rows):
        c.add(turn, role, text, 0)
    assert len(c.blocks) > 20
    marked = [(r, t, "") for _, r, t in rows]
    cost, lines, state = 0, [], ""
    got = c.summary()
    for e, _, role, text in c.edits():
        cost += {"D": 3, "I": 2, "R": 2, "K": 0}[e]
        if e != "D":
            lines.append(f"{role}:{text}")
            state += initial(role)
    assert re.fullmatch("(s?(ua)+)?", state) and cost == got[6] and hashlib.sha256("\n".join(lines).encode()).hexdigest() == got[8]
    import sys

    sys.setrecursionlimit(5_000)
    assert (cost, got[7]) == plain_repair(marked)[:2]
    c.close()


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what:
            text = "" if what == 1 else re.sub("[.!?]", "", text or " ") if what == 2 else text
            out[conv] += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def test_damaged_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    more = [(9_000 + i % 40, i // 40 if i % 7 else None, "user" if i % 2 else None, None if i % 5 == 0 else f"text {i % 3}.") for i in range(300)] + [(None, 1, "user", "Hi."), (8_000, 5, "user", "x")]
    both = df.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(more, "conv_id long, turn long, role string, text string"))
    got = told(conversations.audit(conversations.damage(both), F.col("present")).collect())
    assert got == {c: plain_audit(part) for c, part in plain_damage(rows + more).items()}
    alone = [c for c, part in plain_damage([(i, 1, "user", "x") for i in range(60)]).items() if not part]
    one = conversations.audit(conversations.damage(spark.createDataFrame([(alone[0], 1, "user", "x")], both.schema)), F.col("present")).collect()
    assert told(one) == {alone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repair_of_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.audit(none).count() == 0 and conversations.repair(none).count() == 0


def test_one_exchange_for_all_of_it(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    plan = conversations.audit(conversations.damage(df), F.col("present"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
