"""Registered queries over sources in four brace languages, which are rendered from orders.

Every order is a file: its lines are methods whose lengths and calls follow from quantity and
part, between comments, strings and templates that look like code. The SQL knows the answer
from the same columns without reading the texts.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.plans.catalogue import query
from loomgraph.session import table
from loomgraph.sources import lexer

#: by language: header, method's first lines, its repeated line, its last, footer; k: order, i: place, p: part
TEMPLATES = {
    "typescript": (
        "// class Fake { run() {\nclass Order#k extends Base {\n",
        '  async m#i<T>(x: T, y = "}"): Promise<void> {\n    /* call( { */ const s = `a ${x} { `;\n',
        "    if (x) { this.step#p(x, \"{\", /[{(]/); }\n", "  }\n",
        "}\nfunction top#k(a) {\n  return build#k(a);\n}\n",
    ),
    "java": (
        "package a.b;\npublic class Order#k implements Base {\n",
        "  public <T> int m#i(T x, int y) throws Bad {\n    /* call( { */ String s = \"a } \" + '{';\n",
        "    if (x > 0) { this.step#p(x, new Item(\"{\")); }\n", "  }\n",
        "}\nclass Tail#k { int top#k(int a) {\n  return build#k(a);\n} }\n",
    ),
    "go": (
        "package m\ntype Order#k struct { x map[string]interface{} }\n",
        'func (o *Order#k) m#i(x int, y string) (interface{}, error) {\n\ts := `a { "` // call( {\n',
        '\tif x > 0 { o.step#p(x, "{", s) }\n', "}\n",
        "\nfunc top#k(a int) int {\n\treturn build#k(a)\n}\n",
    ),
    "dart": (
        "import 'a.dart';\nclass Order#k extends Base {\n",
        "  Future<void> m#i(String x, {int y = 0}) async {\n    /* call( { */ final s = '''a } ''';\n",
        "    if (x > 0) { this.step#p(x, '{', s); }\n", "  }\n",
        "}\nint top#k(int a) {\n  return build#k(a);\n}\n",
    ),
}
NAMES = list(TEMPLATES)


def files(spark, d):
    """path, language and content of a file for each order."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(order).alias("i"), F.col("l_partkey").alias("p"), (1 + F.col("l_quantity").cast("int") % 3).alias("r"))
    language = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("k") % len(NAMES) + 1).cast("int"))
    rows = rows.withColumn("language", language)

    def filled(part):
        text = F.lit("")
        for name, parts in TEMPLATES.items():
            one = F.repeat(F.lit(parts[2]), F.col("r")) if part == 2 else F.lit(parts[part])
            text = F.when(F.col("language") == name, one).otherwise(text)
        for mark in ("k", "i", "p") if part in (1, 2, 3) else ("k",):
            text = F.replace(text, F.lit(f"#{mark}"), F.col(mark).cast("string"))
        return text

    methods = rows.select("k", "language", "i", F.concat(filled(1), filled(2), filled(3)).alias("text"))
    whole = methods.groupBy("k", "language").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("body"))
    return whole.select(F.concat(F.lit("src/o"), F.col("k").cast("string")).alias("path"), "language", F.concat(filled(0), "body", filled(4)).alias("content"))


LAID_OUT = """
m AS (SELECT l_orderkey AS k, l_partkey AS p, 1 + CAST(l_quantity AS INT) % 3 AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
laid AS (SELECT k, i, p, r, k % 4 AS lang, 'src/o' || k AS path, CAST(3 + coalesce(sum(3 + r) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM m),
tails AS (SELECT k, lang, path, max(start + 2 + r) AS f FROM laid GROUP BY k, lang, path)"""
SYMBOLS = f"""WITH {LAID_OUT}
SELECT path, 'function' AS type, 'm' || i AS name, start AS start_line, CASE WHEN lang = 3 THEN start ELSE start + 2 + r END AS end_line, CASE WHEN lang <> 2 THEN 'Order' || k END AS parent_class FROM laid
UNION ALL SELECT path, 'class', 'Order' || k, 2, f + 1, NULL FROM tails WHERE lang <> 2
UNION ALL SELECT path, 'class', 'Tail' || k, f + 2, f + 4, NULL FROM tails WHERE lang = 1
UNION ALL SELECT path, 'function', 'top' || k, f + 2, CASE WHEN lang = 3 THEN f + 2 ELSE f + 4 END, CASE WHEN lang = 1 THEN 'Tail' || k END FROM tails"""
CALLS = f"""WITH {LAID_OUT}
SELECT path, CASE WHEN lang <> 2 THEN 'Order' || k || '.' ELSE '' END || 'm' || i AS caller, 'step' || p AS callee, start + 1 + n AS line FROM laid, (VALUES (1), (2), (3)) v(n) WHERE n <= r
UNION ALL SELECT path, CASE WHEN lang = 1 THEN 'Tail' || k || '.' ELSE '' END || 'top' || k, 'build' || k, f + 3 FROM tails"""


@query("src_brace_symbols", SYMBOLS)
def src_brace_symbols(spark, d):
    s, _ = lexer.symbols_and_calls(files(spark, d))
    return s.select("path", "type", "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "parent_class")


@query("src_brace_calls", CALLS)
def src_brace_calls(spark, d):
    _, c = lexer.symbols_and_calls(files(spark, d))
    return c.select("path", "caller", "callee", F.col("line").cast("bigint").alias("line"))
