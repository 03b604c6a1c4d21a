"""Lines repeated across the documents of one source, by token trees.

Every line is parsed into a tree of fixed depth: below the source, one level for
the number of tokens, DEPTH levels for the first tokens, and leaves with the
templates that were met there. At every level and in the templates a token that
holds digits is a wildcard slot: its runs of digits match any others. A template
holds the files its lines stand in.

Each partition grows its own trees, in one pass over its lines. Their branches
are merged by the shuffle in two steps: first the leaves, of which all with fewer
lines than a template needs files are cut off with everything below; then the
files of each template of what is left. The merged trees' templates that stand
in enough files are few (each in min_percent of its source's files) and are what
lines are matched against; up to MAX_SHIPPED of them, which is counted, they go
to every task, beyond that they meet the lines in a join that is salted.

Hot sources and hot lines: a partition has one row of a template and file, all
aggregates combine on the map side, and the join back is salted.

Defined results: null and empty texts have no lines, but their files count;
rows without a source file (null or blank) take no part; blank lines are never
removed; repeated rows are all cleaned; an empty table gives no rows; other
columns are not looked at. Nodes, templates and files are compared by 64-bit
hashes inside a source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut, salted_join

DEPTH = 3
#: Templates and files a partition's trees may hold before they are handed on and grown anew.
GROWN = 2_000_000
MAX_SHIPPED = 200_000
_DIGITS = re.compile("[0-9]+")


def _sourced(df: DataFrame, source_file: str) -> DataFrame:
    name = F.lower(source_file)
    d = df.where(F.trim(source_file) != "")
    return d.withColumn("house", F.split_part(name, F.lit("/"), F.lit(1))).withColumn("file", F.xxhash64(name))


def _folded(df: DataFrame, text: str, source_file: str, *keep: str) -> DataFrame:
    """Lower case, white space of any kind one blank; line feeds stay. Lines are the tasks' business."""
    d = _sourced(df.select(text, source_file, *keep), source_file).where(F.length(text) > 0)
    return d.select("house", "file", *keep, F.regexp_replace(F.lower(text), r"(?U)[\s&&[^\n]]+", " ").alias("text"))


class Slots(dict):
    """Token to its form in a tree: with digits a wildcard slot, else the token itself."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        form = self[token] = _DIGITS.sub("0", token)
        return form


class Tree:
    """Token trees by source; a leaf is a dict of templates (the tokens below the path) with their files and number of lines."""

    def __init__(self) -> None:
        self.root: dict[str, dict] = {}
        self.slots = Slots()
        self.size = 0

    def parse(self, house: str, tokens: list[str]) -> tuple[dict, tuple[str, ...]]:
        """The leaf a line's tokens lead to, and its template there."""
        forms = [self.slots[t] for t in tokens]
        node = self.root.setdefault(house, {}).setdefault(len(forms), {})
        for k in range(min(DEPTH, len(forms))):
            node = node.setdefault(forms[k], {})
        return node, tuple(forms[DEPTH:])

    def add(self, house: str, file: int, line: str) -> None:
        leaf, template = self.parse(house, line.split(" "))
        entry = leaf.get(template)
        if entry is None:
            entry = leaf[template] = {}
        if file in entry:
            entry[file] += 1
        else:
            entry[file] = 1
            self.size += 1

    def leaves(self) -> Iterator[tuple[str, int, list[str], dict]]:
        """(source, number of tokens, first tokens, leaf)."""

        def below(node: dict, path: list[str], depth: int) -> Iterator[tuple[list[str], dict]]:
            if len(path) == depth:
                yield path, node
            else:
                for form, child in node.items():
                    yield from below(child, [*path, form], depth)

        for house, sizes in self.root.items():
            for n, node in sizes.items():
                for path, leaf in below(node, [], min(DEPTH, n)):
                    yield house, n, path, leaf

    def branches(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(source, leaf, template, file, lines)."""
        for house, n, path, leaf in self.leaves():
            head = " ".join(path)
            at = _hash(f"{n} {head}")
            for rest, files in leaf.items():
                template = _hash(" ".join((head, *rest)))
                for file, lines in files.items():
                    yield house, at, template, file, lines


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


_BRANCHES = "house string, leaf bigint, template bigint, file bigint, lines bigint"


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for i, line in enumerate(text.split("\n")):
        line = line.strip(" ")
        if line:
            yield i, line


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Tree()

    def handed(tree: Tree, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 4]
        held: list[tuple] = []
        for b in tree.branches():
            held.append(b)
            if len(held) == rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["house", "leaf", "template", "file", "lines"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], ["house", "leaf", "template", "file", "lines"])

    for b in batches:
        for house, file, text in zip(*(b.column(c).to_pylist() for c in ("house", "file", "text")), strict=True):
            for _, line in _lines(text):
                tree.add(house, file, line)
        if tree.size > GROWN:
            yield from handed(tree)
            tree = Tree()
    yield from handed(tree)


def _match(key: str, wanted: frozenset[tuple[str, int]] | None):
    """(key, line_no, house, template) of lines whose template is wanted; of all lines if there is no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        houses = None if wanted is None else {h for h, _ in wanted}
        for b in batches:
            keys, number, house_, template = [], [], [], []
            for i, (house, text) in enumerate(zip(b.column("house").to_pylist(), b.column("text").to_pylist(), strict=True)):
                if houses is not None and house not in houses:
                    continue
                for n, line in _lines(text):
                    t = _hash(" ".join([slots[x] for x in line.split(" ")]))
                    if wanted is None or (house, t) in wanted:
                        keys.append(i)
                        number.append(n)
                        house_.append(house)
                        template.append(t)
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(keys, pa.int64())), pa.array(number, pa.int32()), pa.array(house_, pa.string()), pa.array(template, pa.int64())],
                [key, "line_no", "house", "template"])

    return run


def templates(
    df: DataFrame, text: str = "text", source_file: str = "source_file", min_files: int = 5, min_percent: int = 8,
) -> DataFrame:
    """(house, template) of the merged trees' templates that stand in enough files of their source."""
    files = _sourced(df.select(source_file), source_file).select("house", "file").distinct().groupBy("house").agg(
        F.count("*").alias("files"))
    need = cut(files.select("house", F.greatest(F.lit(min_files), F.ceil(F.col("files") * min_percent / 100)).cast("bigint").alias("need")))
    grown = cut(_folded(df, text, source_file).mapInArrow(_grow, _BRANCHES))
    # lines of a leaf are at least the files any of its templates stands in
    leaves = grown.groupBy("house", "leaf").agg(F.sum("lines").alias("n")).join(need, "house").where("n >= need").select("house", "leaf")
    left = grown.join(leaves, ["house", "leaf"], "left_semi").select("house", "template", "file").distinct()
    stands = left.groupBy("house", "template").agg(F.count("*").alias("n"))
    return stands.join(need, "house").where("n >= need").select("house", "template")


def excessive_lines(
    df: DataFrame, key: str = "citation_id", text: str = "text", source_file: str = "source_file",
    min_files: int = 5, min_percent: int = 8, max_shipped: int = MAX_SHIPPED,
) -> DataFrame:
    """(key, line_no) of each line to remove."""
    out = cut(templates(df, text, source_file, min_files, min_percent))
    lines = _folded(df, text, source_file, key)
    schema = f"{key} {dict(df.dtypes)[key]}, line_no int, house string, template bigint"
    few = out.limit(max_shipped + 1).collect()
    if len(few) <= max_shipped:
        found = lines.mapInArrow(_match(key, frozenset((r.house, r.template) for r in few)), schema)
    else:
        found = salted_join(lines.mapInArrow(_match(key, None), schema), out, ["house", "template"], F.xxhash64(key, "line_no"))
    return found.select(key, "line_no")


def cleaned(df: DataFrame, key: str = "citation_id", text: str = "text", source_file: str = "source_file") -> DataFrame:
    """(key, text): every row, its excessive lines taken out with their line ends."""
    gone = excessive_lines(df, key, text, source_file).groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    d = df.select(key, text).join(gone, key, "left")
    left = F.expr(f"filter(transform(split({text}, '\n'), (l, i) -> if(array_contains(gone, i), null, l)), l -> l is not null)")
    return d.select(key, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text))
