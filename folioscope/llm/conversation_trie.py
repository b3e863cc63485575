"""Prefix trie of conversations: ternary search trees by range shard, their borders merged."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.operators.joins import lookup_join
from folioscope.staging import stage

#: Turns of a shard, about: what one tree holds.
SHARD_TURNS = 100_000
#: Ids of a listing are carried in pieces of about so many bytes.
PIECE_BYTES = 1 << 20

#: What a path knows of each of its nodes, from the root on, apart from the paths beside it.
LOCAL = "array<struct<members:long,least:long,children:long,leaves:long,saved:long>>"
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, key binary, parent_key binary"
)
_LOCAL = pa.struct([(c, pa.int64()) for c in ("members", "least", "children", "leaves", "saved")])
_PART = pa.schema(
    [
        ("kind", pa.string()),
        *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
        ("ends_sha256", pa.string()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("seq", pa.list_(pa.int64())),
        ("words", pa.list_(pa.int64())),
        ("local", pa.list_(_LOCAL)),
        ("ids", pa.binary()),
    ]
)
PART = f"kind string, {NODE}, seq array<long>, words array<long>, local {LOCAL}, ids binary"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Sequences of codes as a ternary search tree in flat arrays; node 0 is the root, without a code.

    ``low`` and ``high`` lead to siblings of smaller and larger codes, ``down`` to the tree of a
    node's children. Sequences are put in from the median outwards, which balances siblings.
    """

    def __init__(self):
        self.code, self.low, self.high, self.down, self.up = (array("q", [-1]) for _ in range(5))
        self.depth, self.words = array("q", [0]), array("q", [0])
        self.low[0] = self.high[0] = self.down[0] = -1

    def _add(self, code: int, words: int, up: int) -> int:
        for column, value in zip(
            (self.code, self.low, self.high, self.down, self.up, self.words, self.depth),
            (code, -1, -1, -1, up, words, self.depth[up] + 1),
            strict=True,
        ):
            column.append(value)
        return len(self.code) - 1

    def path(self, seq: list[int], words: list[int]) -> list[int]:
        """Nodes of a sequence from the root on, added where they are missing."""
        at, out = 0, [0]
        for code, n in zip(seq, words, strict=True):
            link, here = self.down, at
            while (node := link[here]) >= 0 and self.code[node] != code:
                link, here = (self.low if code < self.code[node] else self.high), node
            if node < 0:
                node = link[here] = self._add(code, n, at)
            at = node
            out.append(at)
        return out

    def __len__(self) -> int:
        return len(self.code)


def from_the_median(n: int) -> Iterator[int]:
    """Places 0 to n - 1: the median, then the medians of both halves, and so on."""
    spans = [(0, n)]
    for first, end in spans:
        if first < end:
            middle = (first + end) // 2
            yield middle
            spans += [(first, middle), (middle + 1, end)]


class Shard:
    """The tree of one shard's paths in order, and what is known of its nodes."""

    def __init__(self, seqs: list[list[int]], words: list[list[int]]):
        self.tree, self.paths = TernaryTree(), [[]] * len(seqs)
        for k in from_the_median(len(seqs)):
            self.paths[k] = self.tree.path(seqs[k], words[k])
        n = len(self.tree)
        self.members, self.children, self.leaves, self.saved = (array("q", bytes(8 * n)) for _ in range(4))
        self.least: list[int | None] = [None] * n

    def note(self, node: int, members: int, least: int | None, children: int = 0, leaves: int = 0, saved: int = 0) -> None:
        self.members[node] += members
        self.children[node] += children
        self.leaves[node] += leaves
        self.saved[node] += saved
        if least is not None and (self.least[node] is None or least < self.least[node]):
            self.least[node] = least

    def borders(self) -> set[int]:
        """Nodes that shards before or after this one may hold too."""
        return {*self.paths[0], *self.paths[-1]}

    def close(self, border: set[int]) -> None:
        """Sum the nodes up from the deepest, without those of the border, which stay apart.

        Closed nodes have their final figures; a border node gains what its closed children have.
        """
        tree = self.tree
        for node in sorted(range(len(tree)), key=tree.depth.__getitem__, reverse=True):
            if node in border:
                continue
            if not self.children[node]:
                self.leaves[node] = 1
            self.saved[node] += (self.members[node] - 1) * tree.words[node]
            if node:
                self.note(tree.up[node], self.members[node], self.least[node], 1, self.leaves[node], self.saved[node])


def path_keys(seq: list[int]) -> list[bytes]:
    """A key for each node of a path, the root first: a chained hash of 16 bytes."""
    out = [b"\0" * 16]
    for code in seq:
        out.append(hashlib.blake2b(out[-1] + code.to_bytes(8, "big", signed=True), digest_size=16).digest())
    return out


def _pieces(ids: list[int]) -> Iterator[tuple[int, bytes]]:
    """Decimal ids, joined by commas, in pieces with the first id of each."""
    step = PIECE_BYTES // 20
    for i in range(0, len(ids), step):
        yield ids[i], ",".join(map(str, ids[i : i + step])).encode()


def _solve(last: bool):
    """A task: the paths of a shard, in order, to rows of nodes, border paths and listings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seqs: list[list[int]] = []
        words: list[list[int]] = []
        ends: list[list[int]] = []
        known: list[list[list[dict]]] = []
        for batch in batches:
            for seq, own, conv, local in zip(*(batch.column(c).to_pylist() for c in ("seq", "words", "conv_id", "local")), strict=True):
                if not seqs or seqs[-1] != seq:
                    seqs.append(seq)
                    words.append(own)
                    ends.append([])
                    known.append([])
                if local is None:
                    ends[-1].append(conv)
                else:
                    known[-1].append(local)
        if not seqs:
            return
        shard = Shard(seqs, words)
        listed: dict[int, list[int]] = {}
        for path, ids, locals_ in zip(shard.paths, ends, known, strict=True):
            if ids:
                shard.note(path[-1], len(ids), ids[0])
                listed[path[-1]] = ids
            for local in locals_:
                for node, of in zip(path, local, strict=True):
                    shard.note(node, **of)
        border = set() if last else shard.borders()
        shard.close(border)
        sides = [] if last else [0] if len(seqs) == 1 else [0, -1]
        keys: dict[int, bytes] = {}
        # Nodes that were on a border before carry a key, by which listings and children find them.
        for k in sides:
            keys.update(zip(shard.paths[k], path_keys(seqs[k]), strict=True))
        for seq, path, locals_ in zip(seqs, shard.paths, known, strict=True):
            if locals_:
                keys.update(zip(path, path_keys(seq), strict=True))
        yield from _rows(_closed(shard, border, keys, listed))
        given: set[int] = set()
        rows = []
        for k in sides:
            local = [_known(shard, node, node in given) for node in shard.paths[k]]
            given.update(shard.paths[k])
            rows.append({"kind": "path", "seq": seqs[k], "words": words[k], "local": local})
        for node in border & listed.keys():
            for first, ids in _pieces(listed[node]):
                rows.append({"kind": "ends", "conv_id": first, "key": keys[node], "ids": ids})
        yield from _rows(iter(rows))

    return run


def _known(shard: Shard, node: int, given: bool) -> dict:
    if given:
        return {"members": 0, "least": None, "children": 0, "leaves": 0, "saved": 0}
    return {
        "members": shard.members[node],
        "least": shard.least[node],
        "children": shard.children[node],
        "leaves": shard.leaves[node],
        "saved": shard.saved[node],
    }


def _closed(shard: Shard, border: set[int], keys: dict[int, bytes], listed: dict[int, list[int]]) -> Iterator[dict]:
    tree = shard.tree
    for node in range(len(tree)):
        if node in border:
            continue
        up = tree.up[node] if node else None
        ids = listed.get(node)
        own = keys.get(node)
        open_parent = up is not None and up in border
        yield {
            "kind": "node",
            "conv_id": shard.least[node],
            "depth": tree.depth[node],
            "parent_conv_id": None if up is None or open_parent else shard.least[up],
            "n_convs": shard.members[node],
            "n_children": shard.children[node],
            "n_leaves": shard.leaves[node],
            "saved_tokens": shard.saved[node],
            "ends_sha256": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() if ids else NO_ENDS,
            "key": own,
            "parent_key": keys[up] if open_parent else None,
        }


def _rows(rows: Iterator[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema=_PART)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_PART)


def _joined(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of listings whose pieces come sorted by (key, first id); one piece is held at a time."""
    key, digest = None, None
    for batch in groups:
        done = []
        for own, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(ids)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "listed"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "listed"])


def coded(turns: DataFrame) -> DataFrame:
    """Staged (conv_id, seq): the turns of each conversation in order, as structs (code, words).

    Distinct (role, text) pairs are told apart by SHA-256 and get a code of 8 bytes each; texts are
    not shuffled. Turns of one number are ordered by role and that hash.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length goes first, so that no two pairs read alike.
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    said = stage(
        turns.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            role.alias("role"),
            F.unhex(F.sha2(whole, 256)).alias("said"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        ),
        "turns",
    )
    codes = stage(said.select("said").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    rows = lookup_join(said, codes, "said", "inner", staged=True)
    # Structs sort by their fields in order; a null turn comes first.
    told = F.sort_array(F.collect_list(F.struct("turn", "role", "said", "code", "words")))
    seq = F.transform("told", lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words")))
    return stage(rows.groupBy("conv_id").agg(told.alias("told")).select("conv_id", seq.alias("seq")), "conversations")


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that begin as others do: c takes the first h turns of c - c % 20, h = crc32(c) % 4."""
    first = convs.where(F.col("conv_id") % 20 == 0).select(
        F.col("conv_id").alias("base"), F.slice("seq", 1, 3).alias("opening")
    )
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    own = convs.select("conv_id", "seq", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), head.alias("head"))
    none = F.slice("seq", 1, 0)
    opening = F.slice(F.coalesce("opening", none), F.lit(1), F.col("head"))
    rest = F.slice("seq", F.col("head") + 1, F.greatest(F.size("seq"), F.lit(1)))
    return own.join(first, "base", "left").select("conv_id", F.concat(opening, rest).alias("seq"))


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for every node of the prefix trie of (conv_id, seq), seq being structs (code, words).

    Paths are dealt to range shards in the order of their codes, equal ones by conv_id, so that
    a path that very many conversations share goes over several shards. Of a shard's nodes only
    those of its first and its last path can occur in other shards. The others are final; these
    paths, with what their nodes have gathered, are the input of the next, much smaller round, until
    they fit one shard. Listings of border nodes travel in pieces.
    """
    spark = convs.sparkSession
    items = stage(
        convs.select(
            F.col("seq")["code"].alias("seq"), F.col("seq")["words"].alias("words"), "conv_id"
        ).withColumn("local", F.lit(None).cast(LOCAL)),
        "paths",
    )
    nodes, listings, first = [], [], True
    while True:
        paths, turns = items.agg(F.count(F.lit(1)), F.sum(F.size("seq") + 1)).first()
        shards = min(-(-(turns or 0) // shard_turns), -(-paths // 4))
        last = not first and shards <= 1
        if last:
            dealt = items.repartition(1)
        else:
            shards = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))) if first else shards
            dealt = items.repartitionByRange(max(1, shards), "seq", "conv_id")
        solved = stage(dealt.sortWithinPartitions("seq", "conv_id").mapInArrow(_solve(last), PART), "trie")
        nodes.append(solved.where("kind = 'node'").select(*(c.split(" ")[0] for c in NODE.split(", "))))
        listings.append(solved.where("kind = 'ends'").select("key", F.col("conv_id").alias("first"), "ids"))
        if last:
            break
        items, first = solved.where("kind = 'path'").select("seq", "words", "conv_id", "local"), False
    return _linked(nodes, listings[0])


def _linked(nodes: list[DataFrame], pieces: DataFrame) -> DataFrame:
    """All nodes, with the parents and listings that border nodes came by only when they were closed."""
    inner, *outer = nodes
    border = outer[0]
    for more in outer[1:]:
        border = border.unionByName(more)
    listed = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_joined, "key binary, listed string")
    border = border.join(listed, "key", "left").withColumn("ends_sha256", F.coalesce("listed", "ends_sha256")).drop("listed")
    border = stage(border, "border")
    every = inner.unionByName(border)
    parents = border.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    late = lookup_join(every.where(F.col("parent_key").isNotNull()), parents, "parent_key", "inner")
    late = late.withColumn("parent_conv_id", F.col("up")).drop("up")
    return every.where(F.col("parent_key").isNull()).unionByName(late).drop("key", "parent_key")


def conversation_trie(turns: DataFrame, rebuild: bool = False, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the prefix trie of the conversations in (conv_id, turn, role, text).

    Turns are in the order of their number, null first; of repeated numbers, by role and text hash;
    repeated rows are turns of their own. A null role or text counts as empty. Rows without a
    conv_id belong to no conversation. No rows give no nodes; other columns are not read. A
    conversation is one array of codes, 16 bytes a turn. ``rebuild``: see ``rebuilt``.
    """
    convs = coded(turns)
    return trie(rebuilt(convs) if rebuild else convs, shard_turns)


#: CRC-32 of the decimal conv_id, which DuckDB has not: eight shifts for each byte.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id,
        list({{'said': md5(to_json([role, text])::VARCHAR),
               'words': len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))}}
             ORDER BY turn NULLS FIRST, role, sha256(text)) AS seq
    FROM turns GROUP BY conv_id
), heads AS (
    SELECT conv_id, seq, {_CRC} % 4 AS h FROM convs
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.seq, [])[:c.h], c.seq[c.h + 1:]) AS seq
    FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), reached AS (
    SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt
), named AS (
    SELECT *, array_to_string(list_transform(seq[:depth], lambda x: x.said), '/') AS node FROM reached
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, arg_min(seq, conv_id) AS seq,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = depth), '')) AS ends_sha256
    FROM named GROUP BY node, depth
), linked AS (
    SELECT *, CASE WHEN depth > 0 THEN array_to_string(list_transform(seq[:depth - 1], lambda x: x.said), '/') END AS above,
        CASE WHEN depth > 0 THEN (n_convs - 1) * seq[depth].words ELSE 0 END AS saved
    FROM nodes
), families AS (
    SELECT above, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY above, depth
), counted AS (
    SELECT n.*, coalesce(f.n_children, 0) AS n_children
    FROM linked n LEFT JOIN families f ON f.above = n.node AND f.depth = n.depth
), spread AS (
    SELECT unnest(range(0, depth + 1)) AS up_to, seq, saved, n_children FROM counted
), sums AS (
    SELECT up_to AS depth, array_to_string(list_transform(seq[:up_to], lambda x: x.said), '/') AS node,
        sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
    FROM spread GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
    s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.node = n.node AND s.depth = n.depth
LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
"""


@query("op13_conversation_trie", SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt to share openings."""
    return conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)
