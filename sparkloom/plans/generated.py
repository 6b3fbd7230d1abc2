"""A module of source text made from a table, a file a row, and SQL for what is in it.

Five rows in a row of keys are a group, and one package; a group's types embed each other in a chain, whose first has a
method that the others get through up to four embedded types. So declarations, calls, ids, method sets and relations of
types follow from keys, and SQL over the same table says what the engine must find."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import edges_of, nodes_of, parsed
from .graph import Graph
from .lineage import cut
from .schema import EDGES
from .tables import load

MODULE, ROOT, PACKAGES, GROUP = "example.com/gen", "/src", 40, 5
#: Files a task, about, so that a task's time doesn't grow with the module.
PART = 10_000
#: Table, key and label: of the module that is read from rows, and of the one that is written as a tree of files.
LARGE, SMALL = ("customer", "c_custkey", "c_mktsegment"), ("nation", "n_nationkey", "n_name")

_LINES = [
    "// Package p{p} holds rows.",
    "package p{p}",
    "",
    "import (",
    '\t"log"',
    '\tcfg "' + MODULE + '/p{q}"',
    ")",
    "",
    "// T{k} is {label}.",
    "type T{k} struct {{",
    "\t{base}",
    "\tsize int",
    "}}",
    "",
    "// I{k} asks.",
    "type I{k} interface {{",
    "\tM{g}(n int) error",
    "}}",
    "",
    "// New{k} makes one.",
    "func New{k}(n int) *T{k} {{",
    '\tlog.Println("new")',
    "\treturn helper{k}(n)",
    "}}",
    "",
    "func helper{k}(n int) *T{k} {{ return &T{k}{{}} }}",
    "",
    "func (t *T{k}) M{g}(n int) error {{ return nil }}",
    "",
    "func (t T{k}) Size() int {{ return t.size }}",
    "",
    "func Use{k}(x *T{k}) error {{",
    "\ty := &T{k}{{}}",
    "\ty.M{g}(1)",
    "\tcfg.New{after}(2)",
    "\treturn nil",
    "}}",
]
#: What only the first of a group has.
_FIRST = ["", "func (t T{k}) Deep{g}() int {{ return 1 }}", "", "// D{g} is deep.", "type D{g} interface {{", "\tDeep{g}() int", "}}"]


def _line(what: str) -> int:
    """The line on which a declaration starts."""
    return next(i for i, x in enumerate([*_LINES, *_FIRST], 1) if x.startswith(what))


METHOD_LINE = _line("func (t *T{k}) M")


def _filled(lines: list[str], columns: dict[str, Column]) -> Column:
    parts = []
    for piece in "\n".join([*lines, ""]).replace("{{", "\x01").replace("}}", "\x02").replace("{", "\x00").replace("}", "\x00").split("\x00"):
        parts.append(columns[piece] if len(parts) % 2 else F.lit(piece.replace("\x01", "{").replace("\x02", "}")))
    return F.concat(*(p.cast("string") for p in parts))


def files(spark: SparkSession, sf_dir: str, of: tuple[str, str, str] = LARGE) -> DataFrame:
    """path, content: the module's files, in even parts whatever the table's own: rows of keys are dealt, and texts made after."""
    table, key, label = of
    rows = load(spark, sf_dir, table).select(F.col(key).cast("long").alias("k"), F.col(label).alias("label"))
    least = rows.agg(F.min("k").alias("least"))
    parts = max(-(-rows.count() // PART), spark.sparkContext.defaultParallelism)
    rows = rows.repartition(parts)
    k, g = F.col("k"), F.floor(F.col("k") / GROUP)
    base = F.when((k % GROUP > 0) & (k > F.col("least")), F.concat(F.lit("T"), (k - 1).cast("string"))).otherwise("// no base")
    columns = {"k": k, "g": g, "p": g % PACKAGES, "q": (g + 1) % PACKAGES, "after": k + GROUP, "label": F.col("label"), "base": base}
    content = F.concat(_filled(_LINES, columns), F.when(k % GROUP == 0, _filled(_FIRST, columns)).otherwise(""))
    path = F.concat(F.lit(f"{ROOT}/p"), (g % PACKAGES).cast("string"), F.lit("/c"), k.cast("string"), F.lit(".go"))
    return rows.crossJoin(F.broadcast(least)).select(path.alias("path"), content.alias("content"))


class Scanned:
    """The large module's parsed files and their graph; each part is written when it is first asked for, and what is not
    asked for is not made."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def rows(self) -> DataFrame:
        return cut(parsed(files(self.spark, self.sf_dir), MODULE, ROOT), "generated")

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(nodes_of(self.rows), "generated-nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return cut(edges_of(self.rows, self.nodes), "generated-edges")

    @property
    def graph(self) -> Graph:
        return Graph(self.nodes, self.edges)

    @property
    def bare(self) -> Graph:
        """The nodes alone, for what reads no edge."""
        return Graph(self.nodes, self.spark.createDataFrame([], EDGES))


_read: dict[tuple[str, str], Scanned] = {}


def scanned(spark: SparkSession, sf_dir: str) -> Scanned:
    """The large module, its parts written once a session."""
    return _read.setdefault((spark.sparkContext.applicationId, sf_dir), Scanned(spark, sf_dir))


def _code(what: str, until: int = 1) -> str:
    """SQL of a declaration's text."""
    at = _line(what) - 1
    lines = [*_LINES, *_FIRST][at : at + until]
    text = "\n".join(lines).replace("'", "''").replace("{{", "\x01").replace("}}", "\x02")
    for name in ("k", "g", "after"):
        text = text.replace("{" + name + "}", f"' || {'k + ' + str(GROUP) if name == 'after' else name} || '")
    return "'" + text.replace("\x01", "{").replace("\x02", "}").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def module_sql(of: tuple[str, str, str] = LARGE) -> str:
    """Common table expressions: c (a row a file), gnodes, gcalls (to placeholders, and resolved), gtypes (relations of types) and gedges."""
    table, key, label = of
    f = lambda name, at: f"'func_' || pk || '_' || {name} || '_' || file || ':{at}'"
    t = lambda name: f"'type_' || pk || '_' || {name}"
    new, helper, m, size, use, deep = (_line(x) for x in ("func New", "func helper", "func (t *T{k}) M", "func (t T{k}) Size", "func Use", "func (t T{k}) Deep"))
    columns = "id, type, package, name, file, line, signature, docstring, code, receiver, kind, methods"
    none = "CAST(NULL AS VARCHAR)"
    asks = "'[{\"name\":\"M' || g || '\",\"signature\":\"func M' || g || '(n int) (error)\"}]'"
    deeps = "'[{\"name\":\"Deep' || g || '\",\"signature\":\"func Deep' || g || '() (int)\"}]'"
    nodes = [
        f"SELECT {t(chr(39) + 'T' + chr(39) + ' || k')}, 'type', pk, 'T' || k, file, {_line('type T')}, {none}, 'T' || k || ' is ' || label || '.', {none}, {none}, 'struct', '[]' FROM c",
        f"SELECT {t(chr(39) + 'I' + chr(39) + ' || k')}, 'interface', pk, 'I' || k, file, {_line('type I')}, {none}, 'I' || k || ' asks.', {none}, {none}, 'interface', {asks} FROM c",
        f"SELECT {t(chr(39) + 'D' + chr(39) + ' || g')}, 'interface', pk, 'D' || g, file, {_line('type D')}, {none}, 'D' || g || ' is deep.', {none}, {none}, 'interface', {deeps} FROM c WHERE k % {GROUP} = 0",
        f"SELECT new_id, 'function', pk, 'New' || k, file, {new}, 'func New' || k || '(n int) (*T' || k || ')', 'New' || k || ' makes one.', {_code('func New', 4)}, {none}, {none}, {none} FROM c",
        f"SELECT helper_id, 'function', pk, 'helper' || k, file, {helper}, 'func helper' || k || '(n int) (*T' || k || ')', '', {_code('func helper')}, {none}, {none}, {none} FROM c",
        f"SELECT use_id, 'function', pk, 'Use' || k, file, {use}, 'func Use' || k || '(x *T' || k || ') (error)', '', {_code('func Use', 6)}, {none}, {none}, {none} FROM c",
        f"SELECT m_id, 'method', pk, 'M' || g, file, {m}, 'func M' || g || '(n int) (error)', '', {none}, '*T' || k, {none}, {none} FROM c",
        f"SELECT {f(chr(39) + 'Size' + chr(39), size)}, 'method', pk, 'Size', file, {size}, 'func Size() (int)', '', {none}, 'T' || k, {none}, {none} FROM c",
        f"SELECT {f(chr(39) + 'Deep' + chr(39) + ' || g', deep)}, 'method', pk, 'Deep' || g, file, {deep}, 'func Deep' || g || '() (int)', '', {none}, 'T' || k, {none}, {none} FROM c WHERE k % {GROUP} = 0",
    ]
    after = f"'func_{MODULE}/p' || q || '_New' || (k + {GROUP})"
    return (
        f"c0 AS (SELECT {key}::BIGINT AS k, {label} AS label, {key}::BIGINT // {GROUP} AS g FROM {table}), "
        f"c1 AS (SELECT *, g % {PACKAGES} AS p, (g + 1) % {PACKAGES} AS q, '{MODULE}/p' || (g % {PACKAGES}) AS pk, '{ROOT}/p' || (g % {PACKAGES}) || '/c' || k || '.go' AS file FROM c0), "
        f"c AS (SELECT *, {f(chr(39) + 'New' + chr(39) + ' || k', new)} AS new_id, {f(chr(39) + 'helper' + chr(39) + ' || k', helper)} AS helper_id, {f(chr(39) + 'Use' + chr(39) + ' || k', use)} AS use_id, {f(chr(39) + 'M' + chr(39) + ' || g', m)} AS m_id FROM c1), "
        f"gnodes({columns}) AS ({' UNION ALL '.join(nodes)}), "
        "last_m AS (SELECT g, arg_max(m_id, file) AS m_id FROM c GROUP BY g), "
        f"gcalls AS (SELECT new_id AS from_id, 'func_log_Println' AS placeholder, 'func_log_Println' AS to_id, {new * 100_000}::BIGINT AS seq, 'import' AS resolution FROM c "
        f"UNION ALL SELECT new_id, 'func_' || pk || '_helper' || k, helper_id, {new * 100_000 + 1}, 'ident' FROM c "
        f"UNION ALL SELECT use_id, 'func_' || pk || '_M' || g, last_m.m_id, {use * 100_000}, 'receiver' FROM c JOIN last_m USING (g) "
        f"UNION ALL SELECT c.use_id, {after.replace('k +', 'c.k +').replace('|| q ||', '|| c.q ||')}, coalesce(n.new_id, {after.replace('k +', 'c.k +').replace('|| q ||', '|| c.q ||')}), {use * 100_000 + 1}, 'import' FROM c LEFT JOIN c n ON n.k = c.k + {GROUP}), "
        f"gtypes AS (SELECT 'type_' || a.pk || '_T' || a.k AS from_id, 'type_' || b.pk || '_I' || b.k AS to_id, 'implements' AS type, true AS pointer_receiver FROM c a JOIN c b USING (g) "
        f"UNION ALL SELECT 'type_' || a.pk || '_T' || a.k, 'type_' || a.pk || '_D' || a.g, 'implements', false FROM c a JOIN c b ON b.g = a.g AND b.k % {GROUP} = 0 "
        "UNION ALL SELECT use_id, 'type_' || pk || '_T' || k, 'accepts', NULL FROM c UNION ALL SELECT new_id, 'type_' || pk || '_T' || k, 'returns', NULL FROM c "
        "UNION ALL SELECT helper_id, 'type_' || pk || '_T' || k, 'returns', NULL FROM c), "
        "gedges AS (SELECT from_id, to_id, 'calls' AS type FROM gcalls UNION ALL SELECT from_id, to_id, type FROM gtypes)"
    )
