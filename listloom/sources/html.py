"""HTML as a node table, with selectors as structural joins and extraction rules as rows.

``nodes`` numbers the nodes of every page in document order: ``lo`` is a node's own number and ``hi`` that of its last
descendant, so containment is a comparison of two numbers and needs no tree. Selectors are joins over this table, one for
each step, of all rules of all sites at once; a site is a set of rule rows, and a new one needs no code.

Defined cases: null html is an empty page; a page that cannot be read to its end keeps what was read; end tags without a
start go, elements that nothing closes end with their parent or where their kind must end; a rule that finds nothing
gives no value. Other columns of the pages are left alone.
"""

from __future__ import annotations

import functools
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listloom.session import Scratch, ship

#: Elements without content, and what the start of an element ends; from the HTML standard. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    **{t: ("p",) for t in "address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
}
#: An implied end does not reach out of these.
SCOPE = frozenset("#page table td th ul ol dl select div section article".split())
RAW = frozenset(("script", "style"))
NODE = pa.schema([
    ("lo", pa.int32()), ("hi", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()),
])
NODE_SQL = "lo int, hi int, parent int, tag string, attrs map<string,string>, text string"


class _Tree(HTMLParser):
    """Nodes of one page, numbered as they begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows = [[0, 0, None, "#page", {}, None]]
        self.open = [self.rows[0]]

    def _add(self, tag, attrs, text=None):
        row = [len(self.rows), len(self.rows), self.open[-1][0], tag, attrs, text]
        self.rows.append(row)
        return row

    def _close(self, depth):
        for row in self.open[depth:]:
            row[1] = len(self.rows) - 1
        del self.open[depth:]

    def _find(self, tags, scope):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][3] in tags:
                return depth
            if self.open[depth][3] in scope:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        depth = self._find(ENDS.get(tag, ()), SCOPE)
        if depth is not None:
            self._close(depth)
        row = self._add(tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in VOID:
            self.open.append(row)

    def handle_endtag(self, tag):
        depth = self._find((tag,), ())
        if depth is not None:
            self._close(depth)

    def handle_data(self, text):
        self._add("#raw" if self.open[-1][3] in RAW else "#text", {}, text)


def _page_nodes(html: str | None, url: str | None) -> list[list]:
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):  # what html.parser raises on malformed declarations
        pass
    tree._close(0)
    tree.rows[0][4] = {} if url is None else {"url": url}
    return tree.rows


def nodes(pages: DataFrame, page: str = "page_id", url: str | None = None, *kept: str) -> DataFrame:
    """(page, kept columns, lo, hi, parent, tag, attrs, text) of ``pages(page, html)``. The page itself is node 0 with
    the tag ``#page``; text is in ``#text`` nodes, that of scripts and styles in ``#raw``."""
    ship(pages.sparkSession)
    keys = (page, *kept)
    address = F.col(url) if url else F.lit(None).cast("string")
    rows = pages.select(*keys, F.col("html").alias("_html"), address.alias("_url"))

    def parse(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = _page_nodes(batch.column("_html")[i].as_py(), batch.column("_url")[i].as_py())
                own = [pa.repeat(batch.column(k)[i], len(found)) for k in keys]
                columns = [pa.array([list(r[k].items()) if k == 4 else r[k] for r in found], NODE.field(k).type) for k in range(6)]
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*keys, *NODE.names])

    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    return rows.mapInArrow(parse, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + NODE_SQL)


def texts_of(selected: DataFrame, table: DataFrame, keys: list[str], tag: str = "#text") -> DataFrame:
    """``selected(page, lo, hi, keys)`` with ``said``: the text below each node, blanks collapsed."""
    inner = table.filter(F.col("tag") == tag).select(F.col("page").alias("p"), F.col("lo").alias("at"), F.col("text").alias("part"))
    below = (F.col("page") == F.col("p")) & (F.col("at") >= F.col("lo")) & (F.col("at") <= F.col("hi"))
    joined = selected.join(inner, below, "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "part"))))
    said = F.array_join(F.transform(parts, lambda x: x["part"]), "")
    return joined.groupBy(*keys).agg(F.trim(F.regexp_replace(said, "[\\s ]+", " ")).alias("said"))


# --------------------------------------------------------------------------------------------------------------------
# rules

STEP = "struct<axis:string,tag:string,attr:string,op:string,value:string,says:string,nth:int>"
RULE_SQL = f"site string, field string, rank int, steps array<{STEP}>, take string, path string, pattern string, form string, many boolean, number int"


def step(axis: str = "in", tag: str | None = None, attr: str | None = None, op: str = "has", value: str | None = None, says: str | None = None, nth: int | None = None) -> tuple:
    """One step of a selector. Axes: in (any depth below), child, after (later siblings), up (what contains it), self. The
    attribute test: has, is, word (one of its words), starts, holds, like (a pattern). ``says``: a pattern of the node's
    whole text. ``nth``: that one of the matches, from 1, or from the end with negative numbers."""
    return (axis, tag, attr, op, value, says, nth)


def rule(site: str, field: str, *steps: tuple, take: str = "text", path: str | None = None, pattern: str | None = None, form: str | None = None, rank: int = 0, many: bool = False) -> tuple:
    """What a field of a site is: where to go, what to take (text, raw, an attribute's name; of raw JSON a ``path``), what
    to keep of it (the first group of ``pattern``), and how to write it (``form``, with ``{}`` for the value). The lowest
    rank that gives a value wins. The field ``@record`` marks the nodes that are listings of their own; without it the
    page is one. ``many`` keeps all values, in order, parted by ``|``."""
    return (site, field, rank, list(steps), take, path, pattern, form, many)


def rules_table(spark: SparkSession, rules: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], RULE_SQL)


def _axis_holds() -> Column:
    """Node columns against those of the frontier (f_)."""
    axis = F.col("s.axis")
    return (
        F.when(axis == "child", F.col("parent") == F.col("f_lo"))
        .when(axis == "after", (F.col("parent") == F.col("f_parent")) & (F.col("lo") > F.col("f_hi")))
        .when(axis == "up", (F.col("lo") < F.col("f_lo")) & (F.col("hi") >= F.col("f_hi")))
        .when(axis == "self", F.col("lo") == F.col("f_lo"))
        .otherwise((F.col("lo") > F.col("f_lo")) & (F.col("lo") <= F.col("f_hi")))
    )


def _test_holds(tag: str | None, attr: str | None, op: str, value: str | None) -> Column:
    kind = F.col("tag") == tag if tag is not None else ~F.startswith("tag", F.lit("#"))
    if attr is None:
        return kind
    got = F.col("attrs")[attr]
    attribute = {
        "is": lambda: got == value,
        "word": lambda: F.array_contains(F.split(got, "\\s+"), value),
        "starts": lambda: F.startswith(got, F.lit(value)),
        "holds": lambda: F.contains(got, F.lit(value)),
        "like": lambda: got.rlike(value),
    }.get(op, got.isNotNull)()
    return kind & F.coalesce(attribute, F.lit(False))


def _tested(table: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page, test, lo, hi, parent) of the nodes that pass the test of some step of their site's rules, and ``rules`` with
    the numbers of their steps' ``tests``. Rules are configuration: their tests are written into one pass over the nodes,
    which joins nothing, with patterns that are compiled once."""
    known: dict[tuple, int] = {}
    told = [
        (r["number"], [known.setdefault((r["site"], s["tag"], s["attr"], s["op"], s["value"]), len(known)) for s in r["steps"]])
        for r in rules.select("number", "site", "steps").collect()
    ]
    passed = [F.when((F.col("site") == site) & _test_holds(*of), F.lit(k)) for (site, *of), k in known.items()]
    each = F.explode_outer(F.array_compact(F.array(*passed))) if passed else F.lit(None).cast("int")
    found = table.select("page", each.alias("test"), "lo", "hi", "parent").filter("test is not null")
    return found, rules.join(F.broadcast(rules.sparkSession.createDataFrame(told, "number int, tests array<int>")), "number")


_PLACE = ("page", "site", "rec", "number", "lo", "hi", "parent")


def _walk(scratch: Scratch, table: DataFrame, tested: DataFrame, starts: DataFrame, rules: DataFrame, depth: int) -> DataFrame:
    """``starts(page, site, rec, lo, hi, parent)`` led along the steps of the rules of their site, ``depth`` at most: the
    places (page, site, rec, number, lo, hi, parent) where the rules end. Each step is one join with the nodes that pass its
    test, staged, so that the plan does not grow with the steps."""
    stepped = F.broadcast(rules.select("site", "number", "steps", "tests"))
    frontier = starts.join(stepped, "site").select(*_PLACE, "steps", "tests")
    ends = [frontier.filter(F.size("steps") == 0).select(*_PLACE)]
    for k in range(depth):
        now = frontier.filter(F.size("steps") > k).withColumns({"s": F.get("steps", F.lit(k)), "test": F.get("tests", F.lit(k))}).drop("steps", "tests")
        now = now.withColumnsRenamed({c: f"f_{c}" for c in ("lo", "hi", "parent")})
        met = scratch.keep(now.join(tested, ["page", "test"]).filter(_axis_holds()).drop("test"))
        keys = [*_PLACE, "f_lo"]
        heard = texts_of(met.filter("s.says is not null"), table, [*keys, "s"]).filter(F.expr("said rlike s.says"))
        found = met.filter("s.says is null").select(*keys, "s.nth").unionByName(heard.select(*keys, "s.nth"))
        of = Window.partitionBy("page", "rec", "number", "f_lo")
        first, last = F.row_number().over(of.orderBy("lo")), F.row_number().over(of.orderBy(F.col("lo").desc()))
        at = F.when(F.col("nth") > 0, first == F.col("nth")).when(F.col("nth") < 0, last == -F.col("nth")).otherwise(True)
        # Two ways to a node are one.
        reached = found.withColumn("ok", at).filter("ok").select(*_PLACE).dropDuplicates(["page", "rec", "number", "lo"])
        reached = scratch.keep(reached.join(stepped.drop("site"), "number").select(*_PLACE, "steps", "tests"))
        scratch.drop(met)
        ends.append(reached.filter(F.size("steps") == k + 1).select(*_PLACE))
        frontier = reached
    return functools.reduce(DataFrame.unionByName, ends)


def extract(table: DataFrame, rules: DataFrame, depth: int = 3) -> DataFrame:
    """(page, site, rec, fields) of ``table(page, site, lo, hi, parent, tag, attrs, text)``, which is staged: a map of the
    fields that the rules of its site give for each record. ``depth``: steps of the longest rule. Rules are configuration
    and broadcast."""
    scratch = Scratch(table.sparkSession, "rules")
    passing, rules = _tested(table, rules)
    tested = scratch.keep(passing)
    marking, telling = rules.filter("field = '@record'"), rules.filter("field <> '@record'")
    roots = table.filter("tag = '#page'").select("page", "site", F.lit(0).alias("rec"), "lo", "hi", "parent")
    cards = _walk(scratch, table, tested, roots, marking, depth).select("page", "site", F.col("lo").alias("rec"), "lo", "hi", "parent")
    whole = roots.join(F.broadcast(marking.select("site").distinct()), "site", "left_anti")
    starts = scratch.keep(cards.unionByName(whole))
    ends = scratch.keep(_walk(scratch, table, tested, starts, telling, depth).join(F.broadcast(rules.drop("site", "steps", "tests")), "number"))
    keys = ["page", "site", "rec", "field", "rank", "number", "lo", "hi", "take", "path", "pattern", "form", "many"]
    said = texts_of(ends.filter("take = 'text'"), table, keys)
    raw = texts_of(ends.filter("take = 'raw'"), table, keys, "#raw")
    named = ends.filter("take not in ('text', 'raw')").join(table.select("page", "lo", "attrs"), ["page", "lo"])
    named = named.select(*keys, F.expr("attrs[take]").alias("said"))
    values = said.unionByName(raw).unionByName(named)
    value = F.expr("CASE WHEN path IS NULL THEN said ELSE get_json_object(said, path) END")
    values = values.withColumn("value", value).withColumn("value", F.expr("CASE WHEN pattern IS NULL THEN value ELSE regexp_extract(value, pattern, 1) END"))
    values = values.withColumn("value", F.nullif(F.trim("value"), F.lit(""))).filter("value is not null")
    values = scratch.keep(
        values.select("page", "site", "rec", "field", "rank", "lo", "many", F.expr("coalesce(replace(form, '{}', value), value)").alias("value"))
    )
    one = values.filter("not many").groupBy("page", "site", "rec", "field").agg(F.min_by("value", F.struct("rank", "lo")).alias("value"))
    listed = values.filter("many").groupBy("page", "site", "rec", "field", "value").agg(F.min(F.struct("rank", "lo")).alias("o"))
    inside = F.array_sort(F.collect_list(F.struct("o", "value")))
    many = listed.groupBy("page", "site", "rec", "field").agg(F.array_join(F.transform(inside, lambda x: x["value"]), "|").alias("value"))
    fields = one.unionByName(many).groupBy("page", "site", "rec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return starts.select("page", "site", "rec").join(fields, ["page", "site", "rec"], "left")
