"""N-gram Jaccard join under several global token orders (operator 8).

A document's set holds its distinct word n-grams. Two sets that are similar enough share a token
among the first ``n - ceil(t n) + 1`` of each under *any* global order of the tokens. The
orders used here put rare tokens first and break ties differently: by exact document frequency,
by its power of two, and by whether a token is shared at all. Two sets are candidates only if they
share a prefix token under every order; candidates are verified exactly.

How it runs. (1) N-grams are hashed inside the tasks and exchanged in packed buckets, which find
each token's document frequency; a token that many documents of one slice share skips the bucket
(it counts as most frequent), so no bucket holds a hot token's whole list. (2) Only tokens of two
documents or more go on, packed, to their documents; all others matter by number alone. (3) Tokens
of the first order's prefixes list their documents, apart for sizes that cannot be similar; equal
lists are kept once. Every document is verified against the hub of each of its lists, which joins
most copies. (4) Of lists that still hold several components, short ones name their open pairs,
long ones are cut into blocks, and each pair of blocks is verified in one task, which returns a
spanning set of its links and never the pairs. (5) Components of the links.

Hashes have 64 bits; a bucket keeps 48 of them beside its own bits. Copies of a text are one node.

Edge cases: null and empty texts have an empty set and are linked with nothing, each is its own
component; a text of fewer than ``width`` words is one token; repeated rows share a component; a
null ``doc_id`` is no name for a component unless no other is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.common import buffers, by_value, components, fenced, hold, released
from clusterloom.llm.words import mix, window_hashes, windows_inside, word_slices

by_value(__name__)

WIDTH, PERCENT = 5, 80
#: Text bytes whose tokens make up one bucket, and documents of one block.
BUCKET_BYTES, BLOCK = 24 << 20, 1024
#: Lists up to this length name their open pairs; longer ones are verified block by block.
SHORT = 32
#: A bucket is worked on in shares of its tokens or documents.
SHARE_BITS = 3
SHARES = 1 << SHARE_BITS
#: Documents of a slice that make a token hot; frequency of a hot token.
HOT, MOST = 32, 65535
SEEDS = tuple(np.uint64(s) for s in (0x1F83D9AB, 0x5BE0CD19, 0x3C6EF372))


def node_of(text: Column) -> Column:
    return F.xxhash64(text)


def shingles(s, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, row) of the distinct n-grams of every row of a slice, sorted by token."""
    sizes = np.diff(s.word_offsets)
    rows = s.row_of_word()
    tokens, owner = [], []
    if len(h) >= width:
        at = windows_inside(s.word_offsets, width)
        tokens.append(window_hashes(h, width)[at])
        owner.append(rows[at])
    for w in range(1, width):
        short = np.flatnonzero(sizes == w)
        if len(short):
            tokens.append(window_hashes(h, w)[s.word_offsets[short]])
            owner.append(short)
    if not tokens:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tok, row = np.concatenate(tokens), np.concatenate(owner)
    order = np.argsort(tok, kind="stable")
    tok, row = tok[order], row[order]
    # Rows ascend within equal tokens of one width, so repeats stand side by side.
    keep = np.ones(len(tok), bool)
    keep[1:] = (tok[1:] != tok[:-1]) | (row[1:] != row[:-1])
    return tok[keep], row[keep]


def set_sizes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, _node, n_shingles)`` per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for s, h in word_slices(batch.column(2)):
                n[s.first:s.last] = np.bincount(shingles(s, h, width)[1], minlength=s.last - s.first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], ["doc_id", "_node", "n_shingles"])

    return docs.select("doc_id", node_of(F.col("text")).alias("_node"), "text").mapInArrow(
        released(run), f"doc_id {kind}, _node long, n_shingles long")


def _runs(values: np.ndarray) -> np.ndarray:
    """Start of every run of equal values, and the length of the array."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


def _pack(bits: int, node, n, tok, df, salt: int) -> Iterator[tuple]:
    """Entries split by the top bits of the node: one row for each part."""
    order = np.argsort(node, kind="stable")
    node, n, tok, df = node[order], n[order], tok[order], df[order]
    part = (node >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(node), np.int64)
    cut = _runs(part)
    for a, b in zip(cut[:-1], cut[1:]):
        runs = _runs(node[a:b])
        yield (int(part[a]), node[a:b][runs[:-1]].tobytes(), n[a:b][runs[:-1]].astype(np.uint32).tobytes(),
               np.diff(runs).astype(np.uint32).tobytes(), tok[a:b].tobytes(), df[a:b].astype(np.uint16).tobytes())


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches that agree in the first ``keys`` columns."""
    current, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(list(r.values())[:keys])
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(r)
    if rows:
        yield current, rows


def _viewed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """As ``_grouped``, with the binary columns after the keys as views, not copies."""
    current, rows = None, []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in range(keys)))
        for key, *row in zip(names, *buffers(batch, range(keys, batch.num_columns))):
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(tuple(row))
    if rows:
        yield current, rows


_ENTRY = "part int, nodes binary, sizes binary, counts binary, tokens binary, dfs binary"
_ENTRY_NAMES = ["part", "nodes", "sizes", "counts", "tokens", "dfs"]


def _entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], _ENTRY_NAMES)


def shared_tokens(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Packed entries (node, size, token, frequency) of all tokens of two documents or more."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for s, h in word_slices(batch.column(1)):
                nodes = ids[s.first:s.last]
                tok, row = shingles(s, h, width)
                fresh = np.zeros(len(nodes), bool)
                fresh[np.unique(nodes, return_index=True)[1]] = True
                tok, row = tok[fresh[row]], row[fresh[row]]
                if not len(tok):
                    continue
                sizes = np.bincount(row, minlength=len(nodes))
                salt += 1
                cut = _runs(tok)
                many = np.diff(cut)
                hot = np.repeat(many >= HOT, many)
                rows = []
                if hot.any():
                    for e in _pack(bits, nodes[row[hot]], sizes[row[hot]], tok[hot] & _keep(bits), np.full(hot.sum(), MOST), salt):
                        rows.append((e[0], salt, *e[1:]))
                # A hot token leaves one entry, the mark of no document, in its bucket.
                first = cut[:-1][many >= HOT]
                rest = np.flatnonzero(~hot)
                at = np.sort(np.concatenate([rest, first]))
                mark = len(nodes)
                owner = np.where(hot[at], mark, row[at])
                token = tok[at]
                bucket = (token >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(token), np.int64)
                parts = _runs(bucket)
                small = token & np.uint64((1 << 48) - 1)
                place = np.uint16 if mark < 65536 else np.uint32
                for a, b in zip(parts[:-1], parts[1:]):
                    rows.append((int(bucket[a]), 0, nodes.tobytes(), sizes.astype(np.uint32).tobytes(), owner[a:b].astype(place).tobytes(),
                                 (small[a:b] >> np.uint64(16)).astype(np.uint32).tobytes(), (small[a:b] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                    ["part", "salt", *_ENTRY_NAMES[1:]])

    def count(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        token, node, size, hot = [], [], [], []
        for nodes, sizes, owner, high, low in rows:
            token.append((high.astype(np.uint64) << np.uint64(16)) | low)
            hot.append(owner == len(nodes))
            owner = np.minimum(owner, len(nodes) - 1)
            node.append(nodes[owner])
            size.append(sizes[owner])
        token, node, size, hot = map(np.concatenate, (token, node, size, hot))
        order = np.argsort(token)
        token = token[order]
        cut = _runs(token)
        n = np.diff(cut)
        if not len(n):
            return
        marked = np.logical_or.reduceat(hot[order], cut[:-1])
        keep = np.repeat((n > 1) | marked, n)
        order, token = order[keep], token[keep]
        node, size, hot = node[order], size[order], hot[order]
        order = np.lexsort((hot, node, token))  # copies of a text in other slices
        token, node, size, hot = token[order], node[order], size[order], hot[order]
        run = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
        group = np.cumsum(run) - 1
        marked = np.bincount(group, hot) > 0 if len(token) else np.zeros(0, bool)
        again = np.zeros(len(token), bool)
        again[1:] = (token[1:] == token[:-1]) & (node[1:] == node[:-1])
        live = ~again & ~hot
        df = np.bincount(group[live], minlength=len(marked)) if len(token) else np.zeros(0, int)
        df = np.where(marked, MOST, np.minimum(df, MOST - 1))
        live &= df[group] > 1
        if live.any():
            full = token[live] | (np.uint64(part << (64 - bits)) if bits else np.uint64(0))
            out = list(_pack(bits, node[live], size[live], full, df[group[live]], 0))
            for i in range(0, len(out), 64):
                yield _entry_batch(out[i:i + 64])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, salt), rows in _viewed(batches, 2):
            if salt:
                for r in rows:
                    yield _entry_batch([(part, *(x.tobytes() for x in r))])
                continue
            views = [(nodes.view(np.uint64), sizes.view(np.uint32), owner.view(np.uint16 if len(nodes) < 8 * 65536 else np.uint32),
                      high.view(np.uint32), low.view(np.uint16)) for nodes, sizes, owner, high, low in rows]
            del rows
            # Tokens of one share at a time, so only the packed rows are held whole.
            for share in range(SHARES):
                some = []
                for nodes, sizes, owner, high, low in views:
                    at = np.flatnonzero(high >> np.uint32(32 - SHARE_BITS) == share)
                    if len(at):
                        some.append((nodes, sizes, owner[at], high[at], low[at]))
                if some:
                    yield from count(part, some)

    sent = docs.select(node_of(F.col("text")).alias("_node"), "text").filter("text is not null").mapInArrow(
        released(scatter), "part int, salt int, nodes binary, sizes binary, counts binary, tokens binary, dfs binary")
    return sent.repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(released(reduce), _ENTRY)


def _keep(bits: int) -> np.uint64:
    """The bits of a token that its bucket keeps."""
    return np.uint64(((1 << 48) - 1) | (((1 << bits) - 1) << (64 - bits)) & 0xFFFFFFFFFFFFFFFF)


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """``(node, n, tokens, prefixes)`` of documents with a shared token in their prefix.

    ``prefixes`` holds the prefix under each order, one after the other.
    """

    def choose(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, size, token, df = map(np.concatenate, zip(*rows))
        order = np.lexsort((token, node))
        node, size, token, df = node[order], size[order].astype(np.int64), token[order], df[order]
        once = np.ones(len(node), bool)
        once[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        node, size, token, df = node[once], size[once], token[once], df[once]
        cut = _runs(node)
        k = np.diff(cut)
        n = size[cut[:-1]]
        prefix = n - (percent * n + 99) // 100 + 1 - (n - k)
        chosen = np.flatnonzero(prefix > 0)
        out = []
        for i in chosen:
            a, b, p = cut[i], cut[i + 1], int(prefix[i])
            t, d = token[a:b], df[a:b].astype(np.int64)
            ranks = (d, np.frexp(d)[1], np.zeros(len(d), np.int64))
            pre = [t[np.lexsort((mix(t ^ seed), rank))[:p]] for seed, rank in zip(SEEDS, ranks)]
            out.append((int(node[a:a + 1].view(np.int64)[0]), int(n[i]), t.tobytes(), np.concatenate(pre).tobytes()))
            if len(out) == 500:
                yield _node_batch(out)
                out = []
        if out:
            yield _node_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _viewed(batches, 1):
            views = [(nodes.view(np.uint64), sizes.view(np.uint32), counts.view(np.uint32), tokens.view(np.uint64), dfs.view(np.uint16))
                     for nodes, sizes, counts, tokens, dfs in rows]
            del rows
            for share in range(SHARES):  # the documents of one share at a time
                some = []
                for nodes, sizes, counts, tokens, dfs in views:
                    mine = mix(nodes) >> np.uint64(64 - SHARE_BITS) == share
                    if mine.any():
                        at = np.repeat(mine, counts)
                        some.append((np.repeat(nodes[mine], counts[mine]), np.repeat(sizes[mine], counts[mine]), tokens[at], dfs[at]))
                if some:
                    yield from choose(some)

    return entries.repartition("part").sortWithinPartitions("part").mapInArrow(
        released(run), "node long, n long, tokens binary, prefixes binary")


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary()), pa.array(d, pa.binary())],
                                      ["node", "n", "tokens", "prefixes"])


def _incidence(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    vocabulary, where = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    seen = np.bincount(where, minlength=len(vocabulary))
    total = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(vocabulary), -1)
    shared = np.flatnonzero(seen > 1)
    for a in range(0, len(shared), 4096):
        place[:] = -1
        place[shared[a:a + 4096]] = np.arange(min(4096, len(shared) - a))
        at = place[where]
        m = np.zeros((len(left) + len(right), min(4096, len(shared) - a)), np.float32)
        m[row[at >= 0], at[at >= 0]] = 1
        total += m[:len(left)] @ m[len(left):].T
    return total


def verify(nodes_a, nodes_b, percent: int, same: bool) -> list[tuple[int, int]]:
    """Spanning links between two lists of ``(node, n, tokens, prefixes)`` (one list if ``same``);
    a fifth value names a component, within which no pair is looked at."""
    n_a, n_b = (np.array([x[1] for x in side], np.int64) for side in (nodes_a, nodes_b))
    low, high = np.minimum(n_a[:, None], n_b[None]), np.maximum(n_a[:, None], n_b[None])
    possible = 100 * low >= percent * high
    if same:
        possible &= np.triu(np.ones(possible.shape, bool), 1)
    if nodes_a and len(nodes_a[0]) > 4:
        part_a, part_b = (np.array([x[4] for x in side]) for side in (nodes_a, nodes_b))
        possible &= part_a[:, None] != part_b[None]
    for k in range(len(SEEDS)):
        if not possible.any():
            return []
        pre = [[np.array_split(x[3], len(SEEDS))[k] for x in side] for side in (nodes_a, nodes_b)]
        possible &= _incidence(*pre) > 0
    rows, cols = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
    if not len(rows):
        return []
    common = _incidence([nodes_a[i][2] for i in rows], [nodes_b[j][2] for j in cols]).astype(np.int64)
    total = n_a[rows][:, None] + n_b[cols][None]
    linked = possible[np.ix_(rows, cols)] & ((100 + percent) * common >= percent * total)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = nodes_a[rows[i]][0], nodes_b[cols[j]][0]
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def links(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Links ``(a, b)`` between text hashes that connect all similar texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / bucket_bytes)))))
    table = hold(candidates(shared_tokens(docs, width, bits), percent))

    base = np.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.array_split(np.frombuffer(x, np.uint64), len(SEEDS))[0] for x in batch.column(2).to_pylist()]
            if first:
                times = [len(x) for x in first]
                n = batch.column(1).to_numpy()
                band = np.repeat(np.floor(np.log(n) / base).astype(np.int64).astype(np.uint64), times)
                for more in (0, 1):  # sizes that can be similar share one of two bands
                    key = mix(np.concatenate(first) + (band + np.uint64(more)) * np.uint64(0x9E3779B97F4A7C15))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), times)), pa.array(np.repeat(n, times)),
                         pa.array(np.repeat(times / n, times))], ["token", "node", "n", "share"])

    postings = table.select("node", "n", "prefixes").mapInArrow(released(explode), "token long, node long, n long, share double")
    # Lists of the same documents lead to the same pairs: one of them is kept. A list's hub is the
    # document whose tokens are shared most, as an original's are.
    lists = postings.groupBy("token").agg(
        F.count("*").alias("m"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.max(F.struct("share", "node", "n")).alias("hub")
    ).filter("m > 1").groupBy("m", "x", "y").agg(F.min("token").alias("token"), F.first("hub").alias("hub"))
    listed = hold(postings.select("token", "node", "n").join(
        lists.select("token", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "token"))

    # Each document against the hubs of its lists: this joins most copies, at one set a pair.
    near = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    stars = listed.filter(near & (F.col("node") != F.col("hub"))).select("node", "hub").distinct()
    found = hold(_verified(stars, table, percent, block))

    # What is left: pairs of different components in lists that hold several.
    parts = components(found)
    tagged = listed.select("token", "node", "n").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    mixed = tagged.groupBy("token").agg(F.count("*").alias("m"), F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y")
    left = hold(tagged.join(mixed.select("token", "m"), "token"))
    # Short lists repeat each other's pairs: those are named first and verified once.
    short = left.filter(F.col("m") <= SHORT).select("token", "node", "n", "part")
    again = short.withColumnsRenamed({"node": "hub", "n": "hub_n", "part": "other"})
    pairs = short.join(again, "token").filter((F.col("node") < F.col("hub")) & (F.col("part") != F.col("other")) & near).select("node", "hub").distinct()
    return found.unionByName(_verified(pairs, table, percent, block)).unionByName(
        _blocks(left.filter(F.col("m") > SHORT), table, percent, block))


def _verified(pairs: DataFrame, table: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among the pairs ``(node, hub)``; a hub's set travels once per block of partners."""
    sized = pairs.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("_k"))
    members = pairs.join(sized, "hub").withColumn("i", F.pmod(F.xxhash64("node"), F.col("_k")).cast("int"))
    centres = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("i"), F.col("hub").alias("node"))
    spokes = members.select("hub", "i", "node").unionByName(centres).join(table, "node").select(
        F.col("hub").alias("token"), "i", (F.col("node") == F.col("hub")).cast("int").alias("j"), "node", "n", "tokens", "prefixes")

    def check_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (hub, _), rows in _grouped(batches, 2):
            sides = [[], []]
            for r in rows:
                sides[r["node"] == hub].append(_member(r))
            for i in range(0, len(sides[0]), 64):
                out = verify(sides[0][i:i + 64], sides[1], percent, False)
                if out:
                    yield _link_batch(out)

    return spokes.repartition("token", "i").sortWithinPartitions("token", "i").mapInArrow(released(check_stars), "a long, b long")


def _blocks(lists: DataFrame, table: DataFrame, percent: int, block: int) -> DataFrame:
    """Links within long lists ``(token, node, part, m)``, by pairs of blocks."""
    placed = (
        lists.withColumn("_k", F.ceil(F.col("m") / block).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64("node", "token"), F.col("_k")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .select("token", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", "part")
    )
    full = placed.join(table, "node").select("token", "i", "j", "_own", "node", "n", "tokens", "prefixes", "part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _grouped(batches, 3):
            sides = [[], []]
            for r in rows:
                sides[r["_own"] != i].append((*_member(r), r["part"]))
            # Pairs within a block are checked with the pair of blocks that names it twice.
            out = verify(sides[0], sides[0], percent, True) if i == j else (verify(*sides, percent, False) if all(sides) else [])
            if out:
                yield _link_batch(out)

    return full.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(released(check), "a long, b long")


def _member(r: dict) -> tuple:
    return r["node"], r["n"], np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["prefixes"], np.uint64)


def _link_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _classes(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles``, ``_node`` and ``_class``, which is null without words."""
    rows = hold(set_sizes(docs, width))
    member = components(links(docs, width=width, percent=percent, **options))
    return rows.join(member.withColumnRenamed("node", "_node"), "_node", "left").withColumn(
        "_class", F.when(F.col("n_shingles") > 0, F.coalesce("component", "_node")))


def cluster(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, **options) -> DataFrame:
    """``(doc_id, n_shingles, component_id, _node)`` of every row."""
    joined = _classes(docs, width=width, percent=percent, **options)
    # Held apart, so that rows of one large class can be dealt to several tasks in the join.
    names = hold(joined.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("_name")))
    named = joined.filter("_class is not null").join(names, "_class").select("doc_id", "n_shingles", F.col("_name").alias("component_id"), "_node")
    return named.unionByName(joined.filter("_class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_node"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of every component: that of the smallest ``doc_id``; all columns as they were.

    Of repeated rows with that id, and of different texts with it, one stays. Documents without
    words are no copies of each other. Columns keep their names, whatever those are.
    """
    docs, back = fenced(docs, "doc_id", "text")
    joined = _classes(docs, **options)
    row = F.struct("doc_id", "_node")
    # A null id is kept only where a component has no other.
    first = joined.filter("_class is not null").groupBy("_class").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), row)), F.min(row)).alias("_first"))
    kept = hold(first.select("_first.*").unionByName(joined.filter("_class is null").select("doc_id", "_node"))
                .select(F.xxhash64("doc_id", "_node").alias("_row")).distinct())
    # Both steps need rows of one key together, so the text moves once.
    marked = docs.withColumn("_row", F.xxhash64("doc_id", node_of(F.col("text"))))
    return back(marked.join(kept, "_row", "left_semi").dropDuplicates(["_row"]))
