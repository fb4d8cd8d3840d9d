"""Structure repair: rules against plain search, queries against a plain version,
long conversations over many tasks and segments, odd rows."""

import collections
import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parityframe.llm import repair as rp
from parityframe.llm import sequences
from parityframe.llm.common import read_table

SCHEMA = "conv_id long, turn long, role string, text string"
WHOLE = re.compile(r"(s?(ua)+)?")


def plain_edits(symbols):
    """(cost, audit) by cheapest-first search over all edit strings; roles are
    checked by the pattern, not by an automaton."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(symbols) and WHOLE.fullmatch(roles):
            return cost, audit
        # What follows depends on the last role alone.
        if (at, roles[-1:], cost, audit) in seen or not any(WHOLE.fullmatch(roles + x) for x in ("", "a", "ua")):
            continue
        seen.add((at, roles[-1:], cost, audit))
        if len(roles) <= 2 * len(symbols) + 2:
            for r in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", at, roles + r))
        if at < len(symbols):
            x = symbols[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, roles))
            if x not in "bd":
                more = x.isupper()
                if x.lower() != "o":
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + x.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, roles + r))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=rp.SYMBOLS, max_size=6), min_size=1, max_size=5))
def test_matrices_are_the_cheapest_edits(strings):
    for string, matrix in zip(strings, rp.string_matrices(strings)):
        cells = [c for c in (rp.times(rp.INSERTS[0], matrix)[s] for s in rp.ACCEPTING) if c]
        assert min((cost, rp.flat(audit)) for cost, audit in cells) == plain_edits(string)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="suab", max_size=60), min_size=1, max_size=6))
def test_rules_spell_the_strings(strings):
    parts, rules = rp.re_pair(strings)

    def spelt(symbol):
        return chr(symbol) if symbol < 256 else "".join(map(spelt, rules[symbol - 256]))
    assert ["".join(map(spelt, p)) for p in parts] == strings
    pairs = collections.Counter(p for part in parts for p in zip(part, part[1:]))
    assert all(n < 2 or a == b for (a, b), n in pairs.items())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="DIKR", max_size=50), min_size=2, max_size=8), st.integers(1, 7))
def test_ropes_compare_as_strings(parts, cut):
    def rope(items):
        return items[0] if len(items) == 1 else rp.Rope(rope(items[:max(1, len(items) // 2)]), rope(items[max(1, len(items) // 2):]))
    a, b = rope(parts), rope(parts[1:] + parts[:1]) if cut % 2 else rp.Rope(rope(parts[:-1]), parts[-1] + "K")
    assert rp.less(a, b) == (rp.flat(a) < rp.flat(b)) and rp.less(b, a) == (rp.flat(b) < rp.flat(a)) and not rp.less(a, a)


def plain_damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            yield from [(conv, turn, "user" if kind == 4 else role,
                         "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)


def plain_summary(ids, rows):
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        by_conv[conv].append(((turn is not None, turn or 0), role.encode(), said, turn, role, text))
    out = {}
    for conv in ids:
        mine = [(t, r, x) for *_, t, r, x in sorted(by_conv[conv], key=lambda v: v[:3])]
        symbols, seen = "", set()
        for _, role, text in mine:
            shown = text.strip(" \t\n\v\f\r")
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "b" if not shown else "d" if (role, text) in seen else first if shown[-1] in ".!?" else first.upper()
            seen.add((role, text))
        # Cheapest-first search is exponential; rows in a line, one state a role.
        best = {"": (0, "", "")}

        def insert(best):
            todo = sorted(best)
            for _ in range(3):
                for last in todo:
                    nxt = "a" if last == "u" else "u"
                    c, audit, roles = best[last]
                    cell = (c + 2, audit + "I", roles + nxt)
                    if nxt not in best or cell[:2] < best[nxt][:2]:
                        best[nxt] = cell
                todo = sorted(best)
            return best
        best = insert(best)
        for x in symbols:
            new = {}

            def put(last, cell):
                if last not in new or cell[:2] < new[last][:2]:
                    new[last] = cell
            for last, (c, audit, roles) in best.items():
                put(last, (c + 3, audit + "D", roles))
                if x not in "bd":
                    more = int(x.isupper())
                    for r in "sua":
                        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
                        if r in fits and r == x.lower():
                            put(r, (c + more, audit + "K", roles + r))
                        elif r in fits and r != "s":
                            put(r, (c + 2 + more, audit + "R", roles + r))
            best = insert(new)
        cost, audit, roles = min(best[k] for k in ("", "a") if k in best)
        lines, at, kept = [], 0, 0
        for edit in audit:
            if edit == "I":
                lines.append({"u": "user", "a": "assistant"}[roles[kept]] + ":")
            else:
                _, role, text = mine[at]
                at += 1
                if edit != "D":
                    lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[roles[kept]]) + ":" + text)
            kept += edit != "D"
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, symbols.count("b"), symbols.count("d"),
                     sum(x.isupper() for x in symbols), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(df):
    return {r[0]: tuple(r)[1:] for r in df.select([c.split()[0] for c in rp.SUMMARY.split(", ")]).collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_by_a_plain_version(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in read_table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = plain_summary({r[0] for r in rows}, list(plain_damage(rows)))
    assert as_dict(rp.op13_structure_repair(spark, folder)) == want
    assert any("I" in w[6] for w in want.values()) and any("R" in w[6] for w in want.values())


def odd_rows():
    rows = [(1, None, None, None), (1, None, "", ""), (1, 5, "user", "Hi.\v\f\r\n "), (1, 5, "user", "Hi.\v\f\r\n "), (1, 8, "user", "Hi.f"), (1, 9, "usr", "é!"),
            (2, 0, "system", "x"), (None, 1, "user", "nobody's."), (None, None, "assistant", "?"), (3, 7, "user", "no stop\x85"),
            (4, 1, "user", " \t"), (4, 2, "user", ""), (5, -3, "user", "a" * 300_000 + "."), (5, 4, "assistant", "b")]
    rows += [(6, i // 2, ("user", "assistant", "system", "tool")[i * i % 7 % 4], f"said {i % 40}" + "." * (i % 3)) for i in range(700)]
    return rows


@pytest.mark.parametrize("bits", [2, 10])
def test_odd_and_long_conversations(spark, monkeypatch, bits):
    for module in (sequences, rp):
        monkeypatch.setattr(module, "SEGMENT_BITS", bits)
    table = spark.createDataFrame(odd_rows(), SCHEMA).withColumns({c: F.lit("extra") for c in ("mid", "symbols", "kind", "said", "phase")})
    ids = {r[0] for r in odd_rows()}
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in odd_rows()]
    want = plain_summary(ids, clean)
    assert as_dict(rp.repair_summary(table)) == want
    turns = collections.defaultdict(list)
    for r in sorted(rp.repaired_turns(table).collect(), key=lambda r: r.place):
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in ids} == {c: w[-1] for c, w in want.items()}
    assert as_dict(rp.repair_summary(rp.damaged(table), table.select("conv_id"))) == plain_summary(ids, list(plain_damage(odd_rows())))


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rp.repair_summary(none).count() == 0 and rp.repaired_turns(none).count() == 0
    lost = as_dict(rp.repair_summary(none, spark.createDataFrame([(8,)], "conv_id long")))
    assert lost == {8: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
