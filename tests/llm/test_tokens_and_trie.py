"""Token counts, token alignment and the prefix trie against plain Python."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyweave.llm import align, counts, trie
from tallyweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "▁", "a▁b", "it's 'tis don't", "x  y \n z\n\n w", "<s></s><0x41><|endoftext|>", "\x00\x1c\x85\xa0", "中文😀 é", "a" * 5000, "Wörter über, alle. 12²3!", "tail \n ", " \n\n lead"]


def documents():
    t = pq.read_table(f"{DATA}/documents.parquet")
    return list(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()))


def random_texts(n):
    r = random.Random(5)
    kinds = ["  ▁\n\tabcdeth 's éß中😀\x00　<s>0x1\x1c\x85\xa0", " \nab, .1", "ab \n\n'."]
    return ["".join(r.choice(kinds[i % 3]) for _ in range(r.randint(0, 30))) for i in range(n)]


# Counts


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=B)


def test_counts_equal_the_library(pieces):
    counter = counts.Counter(counts.PieceRanks(B), most=200)
    texts = [t for t in ODD + random_texts(3000) if t]
    assert [counter.count(t) for t in texts] == [len(x) for x in pieces.encode(texts)]


def test_byte_ranks_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter = counts.Counter(counts.ByteRanks(path, public_tokenizers.PATTERN))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={s.encode("latin-1"): r for s, r in counter.ranks.rank.items()}, special_tokens={})
    texts = [t for t in ODD + random_texts(1000) if t]
    assert [counter.count(t) for t in texts] == [len(library.encode_ordinary(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text("ab", max_size=12), st.dictionaries(st.text("ab", min_size=2, max_size=5), st.integers(0, 5), max_size=8))
def test_merge_takes_the_lowest_then_leftmost_pair(text, rank):
    want = list(text)
    while pairs := [(rank[a + b], i) for i, (a, b) in enumerate(zip(want, want[1:])) if a + b in rank]:
        i = min(pairs)[1]
        want[i : i + 2] = [want[i] + want[i + 1]]
    assert counts.merge(list(text), rank) == want


def test_op13(spark, pieces):
    want = {i: (len((t or "").encode()), len(pieces.encode(t or ""))) for i, t in documents()}
    got = QUERIES["op13_token_counts"](spark, DATA).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(want)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_counts_of_odd_rows(spark, pieces):
    rows = [(i % 7 or None, t, 9) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([*rows, rows[6]], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in counts.count_tokens(docs, B).collect())
    assert got == sorted((d or 0, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t, _ in [*rows, rows[6]])
    assert counts.count_tokens(docs.where("false"), B).count() == 0
    with pytest.raises(Exception, match="needed"):
        counts.worker_counter(A, None)


# Alignment


class Brute:
    """Both tokenizers on whole texts, groups by common ends, links by overlap of all pairs."""

    def __init__(self, pieces):
        self.a, self.b = Tokenizer.from_file(A), pieces
        self.a.encode_special_tokens = True
        self.size = align.PairAligner(A, B)

    def __call__(self, text):
        none = (0, 0, 0, "", collections.Counter())
        if not text:
            return none
        x, y = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        spelt = [[side.bytes_of[i] for i in ids] for side, ids in ((self.size.a, x), (self.size.b, y))]
        if any(b"".join(s) != (" " + text).encode() for s in spelt):
            return none
        ends = [np.cumsum([len(v) for v in s]).tolist() for s in spelt]
        starts = [[0, *e[:-1]] for e in ends]
        links, j0 = collections.Counter(), 0
        for i in range(len(x)):
            while ends[1][j0] <= starts[0][i]:
                j0 += 1
            j = j0
            while j < len(y) and starts[1][j] < ends[0][i]:
                links[x[i] << 32 | y[j]] += 1
                j += 1
        groups, last = [], 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, es) if last < e <= c) for ids, es in ((x, ends[0]), (y, ends[1]))) if len(x) < 400 else "")
            last = c
        return len(x), len(y), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def brute(pieces):
    return Brute(pieces)


def test_alignment_of_texts_equals_brute_force(brute):
    aligner = align.PairAligner(A, B, most=500)
    texts = [t or "" for t in ODD + random_texts(3000)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        numbers, groups, distinct, pairs, times = aligner.align([f" {t}" if t else "" for t in part])
        ends = np.cumsum(distinct)
        for t, n, g, stop, k in zip(part, numbers.tolist(), groups, ends.tolist(), distinct.tolist()):
            n_a, n_b, n_groups, text, links = brute(t)
            assert n == [n_a, n_b, n_groups, links.total()] and (g == text or len(t) >= 400)
            assert dict(zip(pairs[stop - k : stop].tolist(), times[stop - k : stop].tolist())) == links


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 6), min_size=1, max_size=3), st.lists(st.integers(1, 6), min_size=1, max_size=3)), max_size=30))
def test_runs_cover_both_sides_and_close_together(spans):
    a, b, base = [], [], 0
    for x, y in spans:
        width = max(sum(x), sum(y))
        for side, v in ((a, x), (b, y)):
            at = sorted({base + sum(v[: k + 1]) for k in range(len(v) - 1) if sum(v[: k + 1]) < width} | {base + width})
            side += at
        base += width
    runs = list(align.diagonal_runs(a, b))
    assert [i for r in runs for i in range(r[0], r[1])] == list(range(len(a))) and [j for r in runs for j in range(r[2], r[3])] == list(range(len(b)))
    for i, i2, j, j2 in runs:
        assert a[i2 - 1] == b[j2 - 1]
        if a[i] == b[j]:
            assert a[i:i2] == b[j:j2]
        else:
            assert not set(a[i : i2 - 1]) & set(b[j : j2 - 1])


def corpus(rows, brute):
    found = [(d, *brute(t)) for d, t in rows]
    n = collections.Counter(p for *_, links in found for p in links)
    top = collections.defaultdict(int)
    for p, k in n.items():
        top[p >> 32] = max(top[p >> 32], k)
    return sorted((d or 0, a, b, g, links.total(), sum(k for p, k in links.items() if n[p] == top[p >> 32]), sum(k * n[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if a else "") for d, a, b, g, text, links in found)


def flat(df):
    return sorted((r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_op11(spark, brute):
    got, want = flat(QUERIES["op11_token_alignment"](spark, DATA)), corpus(documents(), brute)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    assert all(g[7] == w[7] for g, w in zip(got, want) if w[1] < 400) and sum(0 < w[1] < 400 for w in want) > 20


def test_alignment_of_odd_rows_and_ranges(spark, brute):
    rows = [(i % 5 or None, t) for i, t in enumerate([t for t in ODD if len(t or "") < 400] + random_texts(40))]
    rows.append(rows[6])
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int")
    want = corpus(rows, brute)
    assert flat(align.align_corpus(docs, A, B)) == want
    aligned = align.written(align.align(docs, A, B))
    one, many = ({tuple(r) for r in align.link_strength(aligned, most).collect()} for most in (10**6, 7))
    assert one == many and one
    assert align.align_corpus(docs.where("false"), A, B).count() == 0 and align.align_corpus(docs.where("text is null"), A, B).count() == 1


# Trie


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    inside, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            inside[turns[:d]].append(c)
        ends[turns].append(c)
    children = collections.Counter(n[:-1] for n in inside if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, m in inside.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1]) if n else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(inside[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], digest(ends[n])) for n, m in inside.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(name="conversations"):
    t = pq.read_table(f"{DATA}/{name}.parquet")
    return list(zip(*(t.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))))


def test_op12(spark):
    assert nodes(QUERIES["op12_prefix_trie"](spark, DATA)) == brute_trie(conversations())


def sql_trie(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op12_prefix_trie']})").fetchall())


def test_sql_of_op12():
    rows = [x for x in odd_conversations() if x[0] != 200 or (x[1] or 0) < 20]
    assert sql_trie(rows) == brute_trie(rows)
    assert sql_trie(conversations()) == brute_trie(conversations())


def odd_conversations():
    r = random.Random(3)
    rows = [(c, t if t != 3 else None, r.choice(["user", None, "bot"]), r.choice(["", None, "a", "b", "é😀"])) for c in [*range(0, 40), *range(100, 140), 505, 7_000_000_001] for t in range(r.randint(1, 6))]
    rows += [(5, 2, "user", "again")] * 3 + [(None, 1, "user", "lost"), (600, 1, None, None)]
    rows += [(200, t, "user", "long" if t % 7 else "x" * 300) for t in range(700)]  # a chain
    rows += [(1000 + c, 0, "system", "hub") for c in range(300)]  # equal conversations, one busy parent
    return rows + [(1000 + c, 1, "user", f"leaf {c}") for c in range(0, 300, 2)]


def test_trie_of_odd_rows(spark):
    rows = odd_conversations()
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    want = brute_trie(rows)
    assert nodes(trie.prefix_trie(df)) == want
    assert trie.prefix_trie(df.where("false")).count() == 0


@pytest.mark.parametrize("small", [1, 40])
def test_large_components_are_split_in_rounds(spark, small):
    rows = [x for x in odd_conversations() if x[0] != 200 or (x[1] or 0) < 60]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = trie.written(trie.members(trie.written(trie.numbered_turns(df))))
    tree = trie.written(trie.trie_nodes(paths))
    values = {"size_again": trie.F.lit(1), "deep": trie.F.col("depth")}
    got = {r.node: (r.size_again, r.deep) for r in trie.rollup(tree, paths, values, small).collect()}
    found = tree.collect()
    up = {r.node: r.parent for r in found}
    want = collections.defaultdict(lambda: [0, 0])
    for r in found:
        at = r.node
        while at is not None:
            want[at][0] += 1
            want[at][1] += r.depth
            at = up[at]
    assert got == {n: tuple(v) for n, v in want.items()} and {r.node: r.size for r in found} == {n: v[0] for n, v in want.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=60), st.integers(1, 4))
def test_centroid_sums_equal_walks_to_the_top(draws, trees):
    up = np.array([-1] * trees + [d % (i + trees) for i, d in enumerate(draws)])
    depth, size, want = np.zeros(len(up), np.int64), np.zeros(len(up), np.int64), np.zeros((len(up), 1), np.int64)
    values = np.arange(1, len(up) + 1).reshape(-1, 1) ** 2
    for i in range(len(up)):
        depth[i] = depth[up[i]] + 1 if up[i] >= 0 else 0
        at = i
        while at >= 0:
            size[at] += 1
            want[at] += values[i]
            at = up[at]
    assert (trie.centroid_sums(up, depth, size, values) == want).all()


def test_pattern_of_the_byte_level_vocabulary_is_the_one_known():
    assert regex.findall(public_tokenizers.PATTERN, " it's  a\n\nb") == [" it", "'s", " ", " a", "\n", "\n", "b"]
