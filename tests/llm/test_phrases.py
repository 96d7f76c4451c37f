import re
from collections import Counter, defaultdict

import pytest

from labelops.llm import phrases as P

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, support, top):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in count.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= support}
        inside = {g[i:i + k] for g, a in cand.items() for k in range(2, len(g)) for i in range(len(g) - k + 1)
                  if a >= c[g[i:i + k]]}
        ranked = []
        for g in cand.keys() - inside:
            score, k = min((1000 * c[g] * n[lang] // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -c[g], " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for i, (s, a, g, left, right) in enumerate(sorted(ranked)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def found(docs, **how):
    df = P.collocations(docs, **how)
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(docs, rows, support=5, bits=18, top=70):
    want = brute([(r["text"], r["lang"]) for r in rows], support, top)
    assert found(docs, support=support, cell_bits=bits, top=top) == want and want


def test_full_table_of_cells_changes_nothing(docs, rows):
    """A filter that lets nearly everything through gives the same phrases."""
    want = brute([(r["text"], r["lang"]) for r in rows], 4, 2000)
    assert found(docs, support=4, cell_bits=6) == want


def test_long_paths_and_runs_of_one_word(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(f"x{i} {passage} y{i}", "en") for i in range(6)] + [("ha " * 9, "en"), ("A b. C d, a B;c D", "en")] * 4
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, support=5) == brute(rows, 5, 2000)
    grams, _ = P.gram_table(df, support=5)
    paths = {r.path for r in P.unary_paths(grams.filter("k = 5"), grams.filter("k = 4")).collect()}
    assert passage in paths


def test_parts_of_a_long_text_are_whole(spark):
    rows = [("one two three. four five! six " * 300, "en"), ("no break here " * 200, None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert found(df, support=50, part_bytes=200) == brute(rows, 50, 2000)
    assert [b"".join(P.parts_of(b"ab.cd.ef", 3))] == [b"ab.cd.ef"]


def test_big_counts_are_exact(spark):
    """Products over 64 bits in the score."""
    a, n, left, right = 3_000_000_000_001, 9_000_000_000_007, 3_000_000_000_011, 5_000_000_000_021
    got = spark.sql(f"SELECT (1000BD * CAST({a} AS DECIMAL(17,0)) * CAST({n} AS DECIMAL(17,0)))"
                    f" div (CAST({left} AS DECIMAL(19,0)) * CAST({right} AS DECIMAL(19,0)))").first()[0]
    assert got == 1000 * a * n // (left * right)


def test_null_ties_empty_and_clashing_columns(spark, empty):
    rows = [("b c", None)] * 3 + [("B c", "und")] * 2 + [("d e", "und")] * 5 + [(None, "en"), ("", "en"), (" .\t. ", "de")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, n int")
    want = brute(rows, 5, 2000)
    assert found(df, support=5) == want and [r[2] for r in want] == ["b c", "d e"]
    assert found(empty) == []


@pytest.mark.parametrize("part_bytes", [1 << 20, 100])
def test_grams_are_sent_once_a_task(part_bytes):
    """Slices of a task are summed before they are sent: a row for each language and bucket, whatever the slices."""
    import pyarrow as pa

    class Open:
        value = bytes([255]) * 32

    texts = [(f"{lang} a b c d e{i % 3}.", lang) for i in range(400) for lang in ("en", "de")]
    batch = pa.RecordBatch.from_arrays([pa.array([x[1] for x in texts]), pa.array([x[0].encode() for x in texts])], names=["lang", "text"])
    sent = list(P.gram_counts([Open, Open], 8, 5, part_bytes, buckets=4)([batch]))
    assert sum(b.num_rows for b in sent) <= 2 * 4
    got = Counter()
    for b in sent:
        for i in range(b.num_rows):
            for r in P.merged_grams(pa.Table.from_batches([b.slice(i, 1)])).to_pylist():
                got[r["lang"], r["k"], r["gram"]] += r["n"]
    want = Counter()
    for text, lang in texts:
        w = text[:-1].split()
        for i in range(len(w)):  # all grams are open: edges, and the ends of a piece
            want[lang, min(5, len(w) - i), " ".join(w[i:i + 5]).encode()] += 1
    assert got == want
