"""Clustering, conversation repair and chat formatting against brute force, round trips and odd inputs."""

import hashlib
import itertools
import re

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import chat, queries, repair, sortmeans

TURNS = "conv_id long, turn long, role string, text string"
SAID = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module")
def odd_turns(spark):
    rows = [
        (1, 0, "user", "hi."), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "user", "q?"), (None, None, "assistant", "a!"), (2, None, "system", ""), (2, None, "system", ""),
        (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 5, "assistant", "tie."), (3, 9, "user", "hol"), (4, 1, "", " \t\n "), (5, 0, "tool\nuser", SAID), (5, 1, "assistant", "<\\\\/s> " + SAID + "日本語 🎉 <|end|><<SYS>>"),
        (6, 0, "user", "w " * 300_000 + "."), (6, 1, "assistant", "<" * 20_000 + "|end|>" + "\\" * 20_000), (-3, -2, "assistant", "only."), (-3, 4, "user", "u."),
    ]
    return spark.createDataFrame(rows, TURNS).withColumns({"k": F.lit(1), "live": F.lit("no"), "pos": F.lit(2), "ids": F.lit("x"), "fate": F.lit(0), "fault": F.lit(0)})


# clustering


def plain_kmeans(ids, vectors, k=40, rounds=5):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in zip(ids, vectors, strict=True) if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]
    x = np.array([v for _, v in kept], object)

    def assign():
        d = np.array([((x - np.array(c, object)) ** 2).sum(1) for c in centres], object).T
        return [min(range(len(centres)), key=lambda j: (row[j], j)) for row in d], d

    for _ in range(rounds):
        own, _ = assign()
        for j in range(len(centres)):
            rows = x[[i for i, o in enumerate(own) if o == j]]
            if len(rows):
                centres[j] = [int(s) // len(rows) for s in rows.sum(0)]
    own, d = assign()
    return sorted(((i, j, int(d[r][j])) for r, ((i, _), j) in enumerate(zip(kept, own, strict=True))), key=str), centres


def test_sort_means_equals_plain(spark, root):
    rows = spark.read.parquet(f"{root}/embeddings.parquet").limit(300)
    table = rows.collect()
    got, centres = sortmeans.cluster(rows)
    want, means = plain_kmeans([r["vec_id"] for r in table], [r["embedding"] for r in table])
    assert sorted((tuple(r) for r in got.select("id", "cluster", "distance").collect()), key=str) == want
    assert centres.tolist() == means


def test_sort_means_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = lambda scale=1.0: (rng.normal(size=64) * scale).tolist()
    same = v()
    rows = [(i, v()) for i in range(45)] + [(None, v()), (None, same), (7, same), (7, same), (90, None), (91, []), (92, v()[:63]), (93, [None, *v()[:63]]), (94, [float("nan"), *v()[:63]]), (95, [float("inf"), *v()[:63]])]
    rows += [(96, v(3000.0)), (97, v(60_000.0)), (98, [0.0] * 64), (99, [-0.001] * 64)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "q": F.lit(1), "cluster": F.lit("c"), "hash": F.lit(0)})
    got, centres = sortmeans.cluster(frame)
    want, means = plain_kmeans([r[0] for r in rows], [r[1] for r in rows])
    assert sorted((tuple(r) for r in got.select("id", "cluster", "distance").collect()), key=str) == want and centres.tolist() == means
    few = frame.where("vec_id < 3")
    out = sortmeans.digests(few).collect()
    assert len(out) == 3 and {r["distance"] for r in out} == {0} and len({r["cluster"] for r in out}) == 3
    assert sortmeans.digests(frame.where("false")).collect() == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert sorted(r["distance"] for r in sortmeans.digests(huge, k=1).collect())[-1] > 0


@pytest.mark.parametrize("scale", [30, 1 << 22])
def test_sort_means_scan(scale):
    """The scan gives the nearest centroid with the smallest number from any previous assignment, and skips far ones."""
    rng = np.random.default_rng(scale)
    middle = rng.integers(-scale, scale, (12, 8)) * 40
    x = (middle[rng.integers(0, 12, 3000)] + rng.integers(-scale, scale, (3000, 8))).astype(np.int64)
    c = np.concatenate([middle, middle[:3], x[:9]])
    model = sortmeans.Model(c)
    d = np.stack([((x - row) ** 2).sum(1) for row in c.astype(np.int64)], 1)
    for before in (np.zeros(len(x), int), rng.integers(0, len(c), len(x)), d.argmin(1)):
        near, least, compared = model.assign(x, before)
        assert (near == d.argmin(1)).all() and (least == d.min(1)).all()
    assert compared < 0.5 * len(x) * len(c)


# repair


def brute(turns):
    """The cheapest (cost, audit) by trying every edit; turns: (initial, fault)."""
    best = []

    def inserts(state, cost, audit):
        yield state, cost, audit
        for n in (1, 2):
            for roles in itertools.product("ua", repeat=n):
                yield state + "".join(roles), cost + 5 * n, audit + "I" * n

    def go(i, roles, cost, audit):
        for r, c, a in inserts(roles, cost, audit):
            if i == len(turns):
                if re.fullmatch("(s?(ua)+)?", r):
                    best.append((c, a))
                continue
            initial, fault = turns[i]
            go(i + 1, r, c + 2, a + "D")
            if fault in (0, 3):
                extra = 5 if fault == 3 else 0
                go(i + 1, r + (initial or "-"), c + extra, a + "K")
                for to in "ua":
                    go(i + 1, r + to, c + 1 + extra, a + "R")

    go(0, "", 0, "")
    return min(best)


def test_fold_is_cheapest(spark):
    rng = np.random.default_rng(1)
    cases = [[(["s", "u", "a", "t", ""][rng.choice(5, p=[0.2, 0.35, 0.35, 0.05, 0.05])], int(rng.choice([0, 0, 0, 1, 2, 3]))) for _ in range(n)] for n in [1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3]]
    cases += [[("u", 0)], [("s", 0)], [("a", 0), ("u", 0)], [("u", 0), ("u", 0)], [("u", 0), ("a", 3)], [("s", 0), ("s", 0), ("u", 0)], []]
    frame = spark.createDataFrame([(k, [{"initial": a, "fault": b} for a, b in c]) for k, c in enumerate(cases)], "k int, turns array<struct<initial:string,fault:int>>")
    got = {r["k"]: tuple(r["best"]) for r in frame.select("k", repair.cheapest(repair.fold(F.col("turns"))).alias("best")).collect()}
    assert got == {k: brute(c) for k, c in enumerate(cases)}


def repaired(rows):
    """Flags, edits and repaired text of one conversation's live rows, in Python."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns = set(), []
    for _, role, text in rows:
        left = text.rstrip(repair.SPACE)
        turns.append((role[:1], 1 if not left else 2 if (role, text) in seen else 3 if left[-1] not in ".!?" else 0))
        seen.add((role, text))
    cost, audit = brute(turns)
    out, i = [], 0
    for letter in audit:
        if letter == "I":
            out.append([None, ""])
            continue
        if letter != "D":
            out.append([rows[i][1] if letter == "K" else None, rows[i][2]])
        i += 1
    shift = 1 if out and (out[0][0] or "").startswith("s") else 0
    text = "\n".join(f"{r if r is not None else ('user', 'assistant')[(n + shift) % 2]}:{x}" for n, (r, x) in enumerate(out))
    known = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    faults = [sum(f == k for _, f in turns) for k in (1, 2, 3)]
    return ((max(known) - min(known) + 1 - len(set(known))) if known else 0, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("long", [1024, 2, 1])
def test_repair_odd_rows(spark, odd_turns, long):
    live = odd_turns.select("conv_id", "turn", "role", "text").withColumn("live", ~F.coalesce(F.col("conv_id").isin(4), F.lit(False)))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(live, long=long).collect()}
    by = {}
    for r in odd_turns.collect():
        by.setdefault(r["conv_id"], []).extend([] if r["conv_id"] == 4 else [(r["turn"], r["role"], r["text"])])
    assert got == {k: repaired(v) for k, v in by.items()}
    assert got[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_repair_in_parts(spark, root):
    """Conversations folded part by part, in any part size, cost and read the same."""
    rows = repair.damage(spark.read.parquet(f"{root}/conversations.parquet").withColumn("conv_id", F.col("conv_id") % 7).withColumn("turn", F.col("turn") + 8 * F.col("conv_id")))
    want = rows_of(repair.repair(rows).toPandas())
    assert len(want[1]) == 7 and max(len(r[0]) for r in want[1]) > 10
    for long in (3, 17):
        assert rows_of(repair.repair(rows, long=long).toPandas()) == want


def test_damage(spark, odd_turns):
    import zlib

    got = repair.damage(odd_turns)
    want = []
    for r in odd_turns.collect():
        fate = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        text, role = " " if r["text"] is None else r["text"], " " if r["role"] is None else r["role"]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        want += [(r["conv_id"], r["turn"], "user" if fate == 4 else role, text, fate != 0)] * (2 if fate == 3 else 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert repair.repair(got.where("false")).collect() == []


# chat


@given(st.text(alphabet=st.sampled_from(list("<>[]|/\\sINTSY end")) | st.characters(exclude_categories=["Cs"])) | st.lists(st.sampled_from([*chat.CONTROLS, *chat.MARKS, "\\", "<", "["])).map("".join))
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(c in safe for c in [*chat.CONTROLS, *chat.MARKS])


def plain_digest(rows):
    rows = sorted(((t, r or "", x or "") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}\n{r[2]}".encode()).digest()))
    loss = "".join(x for _, r, x in rows if r == "assistant")
    chars = sum(len(chat.escape(r)) + len(chat.escape(x)) + len("<|turn|>" + ("<|say|>" if r == "assistant" else "<|read|>") + "<|end|>") for _, r, x in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(rows), sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), sha(loss), chars


def test_chat_odd_rows(spark, odd_turns):
    formatted = chat.format_turns(odd_turns)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(formatted).collect()}
    by = {}
    for r in odd_turns.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got == {k: plain_digest(v) for k, v in by.items()}
    assert chat.read_back(chat.format_turns(odd_turns.where("false"))).collect() == []
    named = odd_turns.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert {r[0] for r in chat.read_back(chat.format_turns(named)).collect()} == {f"c{k}" if k is not None else None for k in by}


def test_chat_tokens(spark, root):
    """Segments' ids are the vocabulary's own, marks stand between them, and the mask covers learned texts only."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    rows = chat.with_test_conversation(spark.read.parquet(f"{root}/conversations.parquet")).where("conv_id < 12")
    texts = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in rows.collect()}
    first = chat.vocabulary(None)[2]
    for r in chat.format_turns(rows).collect():
        role, text = texts[r["conv_id"], r["turn"]]
        body = own.encode(chat.escape(text), add_special_tokens=False).ids
        head = [first, *own.encode(role, add_special_tokens=False).ids, first + (1 if role == "assistant" else 2)]
        assert r["ids"] == [*head, *body, first + 3]
        assert r["loss"] == [False] * len(head) + [role == "assistant"] * len(body) + [False]
    sql = queries.ORACLE_SQL["op13_chat_format"]
    assert "conversations" in sql
