"""Merkle manifest of a dataset, built and verified by supersteps of messages between the nodes of its trees.

Each row is a leaf; the rows of a source make a tree, FAN consecutive nodes a run with one parent; what remains of each
tree, its subroot, is a leaf of the tree over all sources, whose last node is the root. Every node is a vertex with a key
(tree, index) at its level. Upward supersteps: children message (position, digest) to their parents; a parent that has
all the children it is to have hashes them and sends its own digest on. Downward supersteps: from the root, every parent
sends each child the path above it, one (position, digests of the run) a level. A run of leaves gets one path for all of
its members and folds each leaf with it: the proof is complete without any node having seen more than one run a level.

A digest is lowercase hex SHA-256. A leaf's is that of its columns, each "-" if null, else its UTF-8 byte count, ":" and
its value; a node's is that of its children's digests as text, one after the other.

Texts are hashed where they are read and travel no further. Leaves are numbered within sources by an ordered scan, so a
source that holds most rows is dealt to all tasks like any other; messages meet by (tree, run), at most FAN a key. The
number of supersteps is the depth of the deepest tree and of the tree of sources. Leaves and their numbers are tables in
the shared folder, from which lost messages are made again.

Defined cases: null keys stand first, a null source is a source of its own; equal keys are ordered by digest, so equal
rows stand side by side and have proofs of their own; a lone leaf is its tree's subroot, and the root if there is no
other; its proof is empty. An empty table gives an empty result. Other columns, whatever their names, are not hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import numbered
from .shared import written

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Messages of a superstep that one task is to have at least, before more tasks are used.
MESSAGES = 2_000


def leaf_digest(columns: Iterable[Column]) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns)), 256)


def node_digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _above(n: int) -> int:
    return -(-n // FAN)


def depth(n: int) -> int:
    steps = 0
    while n > 1:
        n, steps = _above(n), steps + 1
    return steps


def _completed(item: tuple) -> tuple:
    """A parent with all its children, in order: (key, (nodes of the children's level, [(position, digest, rest)]))."""
    key, messages = item
    messages = sorted(messages, key=lambda m: m[1])
    n = messages[0][0]
    if len(messages) != min(FAN, n - FAN * key[1]):
        raise ValueError(f"node {key} has {len(messages)} of its children")
    return key, (n, [m[1:] for m in messages])


def climb(nodes: RDD, most: int, total: int, tasks: int) -> tuple[list[RDD], list[RDD]]:
    """Runs by level and, by level, the nodes that are the last of their tree there.

    nodes: ((tree, index), (nodes of the tree at this level, digest, rest)); most: leaves of the largest tree; total: of
    all. Runs: ((tree, index of the parent), (nodes of the level, [(position, digest, rest)]))."""
    runs, last = [], []
    for _ in range(depth(most)):
        last.append(nodes.filter(lambda x: x[1][0] == 1))
        sent = nodes.filter(lambda x: x[1][0] > 1).map(lambda x: ((x[0][0], x[0][1] // FAN), (x[1][0], x[0][1] % FAN, *x[1][1:])))
        here = sent.groupByKey(min(tasks, total // MESSAGES + 1)).map(_completed, preservesPartitioning=True)
        runs.append(here)
        nodes = here.map(lambda x: (x[0], (_above(x[1][0]), node_digest(d for _, d, _ in x[1][1]), None)), preservesPartitioning=True)
        total = _above(total)
    last.append(nodes)
    return runs, last


def _met(states: RDD, messages: RDD) -> RDD:
    """(key, state, message) of vertices that got one."""
    n = states.getNumPartitions()
    both = states.mapValues(lambda s: (0, s)).union(messages.mapValues(lambda m: (1, m)).partitionBy(n)).groupByKey(n)

    def pair(item):
        found = dict(item[1])
        if 0 in found and 1 in found:
            yield item[0], found[0], found[1]

    return both.flatMap(pair)


def descend(runs: list[RDD], paths: list[RDD]) -> RDD:
    """((position, digest, rest), path) of every leaf below the given nodes; a path has (position, digests) a level, from
    the leaf's own run up. paths: by level, (key, path above it) of the trees' last nodes."""
    found, arriving = None, paths[-1]
    for level in range(len(runs) - 1, -1, -1):
        met = _met(runs[level], arriving)

        def sent(x):
            (tree, parent), (_, children), path = x
            digests = [d for _, d, _ in children]
            for position, digest, rest in children:
                yield (tree, FAN * parent + position), ((position, digest, rest), [(position, digests), *path])

        children = met.flatMap(sent)
        if level == 0:
            found = children.values()
        else:
            arriving = children.mapValues(lambda x: x[1]).union(paths[level])
    return found


def fold(digest: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf's digest and the digests of its siblings make."""
    for position, digests in path:
        digest = node_digest([*digests[:position], digest, *digests[position + 1 :]])
    return digest


def siblings(path: list[tuple[int, list[str]]]) -> list[str]:
    return [d for position, digests in path for k, d in enumerate(digests) if k != position]


def _mark(digest: str) -> tuple[int, list[str]]:
    """The digest of a tree's last node in the paths below it: the first such mark is the subroot, the last the root."""
    return -1, [digest]


def verify(docs: DataFrame, claims: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS, tree: str = "source", key: str = "doc_id", proofs: bool = False) -> DataFrame:
    """(key, tree, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, and its proof if asked for.

    The manifest is that of the columns. claims: values that are checked against it in place of the columns of that name;
    folded_root is what the claimed leaf and the manifest's siblings make, and verified says whether it is the root. A
    proof is an array of the siblings' digests, level by level from the leaf's run up, left to right.
    """
    spark, claims = docs.sparkSession, claims or {}
    own = leaf_digest(F.col(c) for c in columns)
    claimed = leaf_digest(claims.get(c, F.col(c)) for c in columns)
    leaves = written(docs.select(F.col(key).alias("key"), F.col(tree).alias("tree"), own.alias("leaf"), claimed.alias("claimed")), "leaves")
    placed = written(numbered(leaves, ["key", "leaf", "claimed"], ("tree",), "n", "tree_n"), "numbered-leaves")
    sized = placed.groupBy("tree_n").agg(F.max("n").alias("size"))
    total, trees, most = sized.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(0))).head()
    kind, names = docs.schema[key].dataType, docs.schema[tree].dataType
    fields = [("key", kind), ("tree", names), *((n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", T.BooleanType())]
    if proofs:
        fields.append(("proof", T.ArrayType(T.StringType())))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    if not total:
        return spark.createDataFrame([], schema).withColumnsRenamed({"key": key, "tree": tree})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.broadcast(sized) if trees <= 100_000 else sized
    rows = placed.join(size, "tree_n").select("tree_n", "n", "size", "leaf", "key", "tree", "claimed").rdd
    nodes = rows.map(lambda r: ((r[0] - 1, r[1] - 1), (r[2], r[3], (r[4], r[5], r[6]))))
    runs, last = climb(nodes, most, total, tasks)

    # The last node of each tree is a leaf of the tree over all of them; it knows where it stands in its own.
    tops = [x.map(lambda x, level=level: ((0, x[0][0]), (trees, x[1][1], (x[0], level, x[1][2])))) for level, x in enumerate(last)]
    upper = tops[0]
    for x in tops[1:]:
        upper = upper.union(x)
    top_runs, top_last = climb(upper, trees, trees, tasks)
    if top_runs:
        placed_tops = descend(top_runs, [x.map(lambda x: (x[0], [_mark(x[1][1])])) for x in top_last])
    else:  # one tree: its subroot is the root
        placed_tops = upper.map(lambda x: ((0, *x[1][1:]), [_mark(x[1][1])]))

    # Paths go on down each tree from its last node, at whatever level that stands.
    def arriving(level: int) -> RDD:
        here = placed_tops.filter(lambda x: x[0][2][1] == level)
        return here.map(lambda x: (x[0][2][0], [_mark(x[0][1]), *x[1]]))

    def result(x):
        (_, leaf, (name, source, claim)), path = x
        marks = [digests[0] for position, digests in path if position < 0]
        path = [step for step in path if step[0] >= 0]
        near, folded = siblings(path), fold(claim, path)
        row = (name, source, leaf, marks[0], marks[-1], node_digest(near), folded, folded == marks[-1])
        return (*row, near) if proofs else row

    lone = placed_tops.filter(lambda x: x[0][2][1] == 0).map(lambda x: ((0, x[0][1], x[0][2][2]), [_mark(x[0][1]), *x[1]]))
    found = lone.map(result)
    if runs:
        found = descend(runs, [arriving(level) for level in range(len(runs) + 1)]).map(result).union(found)
    return spark.createDataFrame(found, schema, verifySchema=False).withColumnsRenamed({"key": key, "tree": tree})
