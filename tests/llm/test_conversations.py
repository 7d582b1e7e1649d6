"""Operator 12 against a backward search of its own, with conversations in chunks too."""

import hashlib
import random

import pytest
from quillstone.llm import conversations as C

COLUMNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256().hexdigest()


def follows(state, initial):
    return initial in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[state] and initial != ""


def expected(rows):
    """Least repair of a conversation, from its end to its start."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows if r is not None or x is not None]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    states = ("", "s", "u", "a")
    later = {s: (0, "", ()) if s in ("", "a") else None for s in states}

    def inserts(now):
        for _ in range(5):
            for s in states:
                for role in ("user", "assistant"):
                    rest = now[role[0]]
                    if follows(s, role[0]) and rest:
                        now[s] = min(filter(None, (now[s], (rest[0] + 3, "I" + rest[1], (role + ":", *rest[2])))))
        return now

    later = inserts(later)
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for s in states:
            found = [(later[s][0] + 4, "D" + later[s][1], later[s][2])] if later[s] else []
            for letter, to, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)) if fault not in ("b", "d") else ():
                rest = later.get(to[:1])
                if follows(s, to[:1]) and rest:
                    found.append((rest[0] + cost + 3 * (fault == "t"), letter + rest[1], (f"{to}:{text}", *rest[2])))
            now[s] = min(found, default=None)
        later = inserts(now)
    cost, audit, said = later[""]
    turns, initials = [r[0] for r in rows if r[0] is not None], [r[1][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def agree(rows):
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = [tuple(r) for r in C.repair(rows).collect()]
    assert len(got) == len(groups)
    for conv, *rest in got:
        assert tuple(rest) == expected(groups[conv]), (conv, groups[conv])


def noisy(n, seed, ids, turns):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "ux"]
    texts = ["a.", "b!", "c", " \x0b", "", None, "d?", "e ", "f. ", "g.\n", "h ."]
    return [(rnd.choice(ids), rnd.choice(turns), rnd.choice(roles), rnd.choice(texts)) for _ in range(n)]


def test_nulls_ties_and_repeats(spark):
    agree(spark.createDataFrame(noisy(160, 1, [None, *range(12)], [None, *range(9)]), COLUMNS).repartition(3))


@pytest.mark.parametrize("seed", [2, 3])
def test_chunks_give_the_same(spark, monkeypatch, seed):
    monkeypatch.setattr(C, "CHUNK_ROWS", 3)
    agree(spark.createDataFrame(noisy(120, seed, [None, 1, 2], [None, *range(30)]), COLUMNS).repartition(4))


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, k % 900, "user" if k % 2 else "assistant", "same." if k % 3 else f"t{k}") for k in range(5000)] + [(k, 1, "user", "x.") for k in range(20)]
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()}
    one = [(t, r, x) for c, t, r, x in rows if c == 7]
    assert tuple(got[7])[1:] == expected(one) and got[7].duplicate > 3000 and got[3].audit == "KI"


def test_no_rows_long_texts_and_extra_columns(spark):
    assert C.repair(spark.createDataFrame([], COLUMNS)).collect() == []
    rows = [(1, None, None, None), (2, 1, "user", "w " * 3_000_000 + "."), (2, 2, "assistant", "y" * 5_000_000 + "!"), (3, -(1 << 63), "user", "a."), (3, (1 << 63) - 1, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS + ", who long, part long")
    got = {r.conv_id: tuple(r)[1:] for r in C.repair(df).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", EMPTY) and got[2] == expected([r[1:] for r in rows[1:3]]) and got[3][0] == (1 << 63) - 1


def test_damage(spark):
    rows = [(c, t, r, "One. Two!") for c in (*range(30), None) for t, r in ((0, "system"), (1, "user"), (2, "assistant"), (None, None))]
    hurt = C.damage(spark.createDataFrame(rows, COLUMNS))
    got, ids = hurt.collect(), {r[0] for r in rows}
    import zlib

    kind = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    assert {r.conv_id for r in got} == ids
    for r in got:
        k = kind(r.conv_id, r.turn)
        assert (r.role is None) == (k == 0) and r.text == {0: None, 1: "", 2: "One Two"}.get(k, "One. Two!") and (k != 4 or r.role == "user")
    assert len(got) == len(rows) + sum(kind(c, t) == 3 for c, t, _, _ in rows)
    agree(hurt)
