import random

import pytest
from corpus import odd_rows

from lanewise.llm.line_runs import remove_repeated_lines, suffix_array


def brute(rows, min_lines, min_words):
    """Rows (doc_id, text) without later copies; all windows of every length from min_lines on, over lines that aren't blank, are looked at."""
    docs = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, gone, often, spans = {}, {}, {}, {}
    for doc in docs:
        lines = doc[1].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        dead, spans[doc] = set(), []
        for i in range(len(full)):
            for n in range(1, len(full) - i + 1):
                run = tuple(lines[j] for j in full[i : i + n])
                if n >= min_lines or n == 1 and len(run[0].split()) >= min_words:
                    often[run] = often.get(run, 0) + 1
                    spans[doc].append((i, n, run, run in first))
                    if run in first:
                        dead |= set(full[i : i + n])
                    else:
                        first[run] = doc
        gone[doc] = dead
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0, 0, ()))
            continue
        lines = r[1].split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\x0b\f\r")]
        copies = {}
        for i, n, run, later in spans[r]:
            if later and n in (1, min_lines):
                for j in range(i, i + n):
                    copies[j] = max(copies.get(j, 0), often[run])
        runs = []
        for j in sorted(copies):
            if runs and runs[-1][1] == j - 1:
                runs[-1] = [runs[-1][0], j, min(runs[-1][2], copies[j])]
            else:
                runs.append([j, j, copies[j]])
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in gone[r]), len(lines), len(gone[r]), tuple((full[a], b - a + 1, c) for a, b, c in runs)))
    return sorted(out, key=str)


def run(spark, rows, min_lines, min_words):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeated_lines(df, min_lines=min_lines, min_words=min_words).collect()
    return sorted(((*r[:4], tuple(map(tuple, r["removed_runs"]))) for r in got), key=str)


@pytest.mark.parametrize(("min_lines", "min_words"), [(2, 4), (3, 4), (5, 100)])
def test_against_brute_force(spark, min_lines, min_words):
    rng = random.Random(min_lines)
    lines = [" ".join(f"l{i}" for _ in range(rng.randrange(1, 6))) + f" {i}" for i in range(6)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice([*lines, f"only {i} {j}"]) for j in range(rng.randrange(1, 14)))) for i in range(40)]
    assert run(spark, rows, min_lines, min_words) == brute(rows, min_lines, min_words)


@pytest.mark.parametrize("ranges", [1, 20])
def test_joined_by_shuffles(spark, monkeypatch, ranges):
    """Tables beyond the size for a broadcast, and a hot line with many followers."""
    from lanewise.llm import _store, line_runs

    monkeypatch.setattr(_store, "MOST_BROADCAST", 0)
    monkeypatch.setattr(line_runs, "MOST_RANGES", ranges)
    rows = [(i, "\n".join(["hot line", f"after {i % 40}", "hot line", f"then {i % 7}", "", f"own {i}"])) for i in range(90)]
    assert run(spark, rows, 2, 9) == brute(rows, 2, 9)
    assert run(spark, rows, 3, 9) == brute(rows, 3, 9)


@pytest.mark.parametrize(("broadcast", "ranges"), [(500_000, 20), (0, 1)])
def test_whole_suffix_array(spark, monkeypatch, broadcast, ranges):
    """Ranks and common prefixes go on past min_lines, over segments that end alike, contain each other or hold one line over and over."""
    from lanewise.llm import _store, line_runs

    monkeypatch.setattr(_store, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(line_runs, "MOST_RANGES", ranges)
    rng = random.Random(7)
    passage = [rng.randrange(-4, 4) << 61 for _ in range(21)]
    docs = [passage, passage[:], [9, *passage[3:], 9], passage[:13], [0] * 18, [0] * 7, [5], [5]] + [[rng.randrange(-2, 2) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
    rows = [(bytes([d]), d, i + 3 * (i >= 15), line, ~line, False) for d, doc in enumerate(docs) for i, line in enumerate(doc)]
    suffixes = {}
    for d, doc in enumerate(docs):
        for part, shift in ((doc[:15], 0), (doc[15:], 18)):
            suffixes |= {(d, shift + i): tuple((x, ~x) for x in part[i:]) for i in range(len(part))}
    array, neighbours = suffix_array(spark.createDataFrame(rows, "doc binary, key long, at int, line long, twin long, long boolean").repartition(3), len(rows))
    ordered = sorted(suffixes.values())
    assert {(r["key"], r["at"]): r["rank"] for r in array.collect()} == {k: ordered.index(s) for k, s in suffixes.items()}
    distinct = sorted(set(ordered))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = [(ordered.index(s), common(s, before)) for s, before in zip(distinct, [(), *distinct], strict=False)]
    assert sorted(map(tuple, neighbours.collect())) == want and max(n for _, n in want) > 8


def test_double_spaced_passage(spark):
    """A passage of short lines with blank ones between is a run; blank lines stay."""
    passage = "\n\n".join(f"short line {i}" for i in range(20))
    rows = [(1, passage), (2, f"mine\n\n{passage}\n\nand mine")]
    assert run(spark, rows, 2, 5) == brute(rows, 2, 5)
    got = {r["doc_id"]: r for r in remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == passage and got[2]["text"].split() == ["mine", "and", "mine"]
    assert [tuple(r) for r in got[2]["removed_runs"]] == [(2, 20, 2)]


def test_odd_rows(spark):
    rows = [(a, b) for a, b, *_ in odd_rows()]
    assert run(spark, rows, 2, 5) == brute(rows, 2, 5)
    df = spark.createDataFrame([(1, "a b\nc d", "x"), (2, "a b\nc d", "y")], "doc_id long, text string, n_lines string").selectExpr("*", "'z' as doc", "1 as gone", "2 as body")
    got = remove_repeated_lines(df)
    assert {(r["doc_id"], r["text"], r["n_removed"], r["doc"], r["gone"], r["body"]) for r in got.collect()} == {(1, "a b\nc d", 0, "z", 1, 2), (2, "", 2, "z", 1, 2)}
    assert remove_repeated_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_lines(df, min_lines=0)
