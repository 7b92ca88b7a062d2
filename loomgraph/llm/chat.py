"""Chat formatting: records of many layouts to canonical turns, one template, and back.

A record's layout is told by a fingerprint: the SHA-256 of its nested field paths.
A registry maps fingerprints to declarative mappings; each says which JSON paths
become which turns. Only DataFrame functions are used.

Defined results: a null text is the empty text; a null role is the empty role; equal
turn numbers are ordered by role, then text, and repeated rows all stay; null turn
numbers come first; an empty table gives an empty result; columns that no mapping
names are ignored. Records whose fingerprint no mapping has come back from
``unmapped`` and give no turns. Rows with a null conversation id form one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, MIDDLE, END = "<|start|>", "<|message|>", "<|end|>"
#: Control strings of this template and of common others; a backslash goes behind
#: their first character wherever they stand in a text.
CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


@dataclass(frozen=True)
class Mapping:
    """How the records of one layout become turns.

    ``fixed``: (role, JSON path) pairs, a turn each, in order; paths that are absent or
    null are left out when ``optional`` names them. ``items``: JSON path of an array of
    turns, with the keys of role and text. ``row``: the record is itself one turn, with
    paths of its number, role and text.
    """

    name: str
    paths: tuple[str, ...]
    fixed: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict, hash=False)


PEOPLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
REGISTRY = (
    Mapping("turn_row", ("role", "text", "turn"), row=("$.turn", "$.role", "$.text")),
    Mapping("prompt_completion", ("completion", "prompt"), fixed=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", ("prompt", "response"), fixed=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("instruction", ("instruction", "output"), fixed=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction_input", ("input", "instruction", "output"), fixed=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output")), optional=("$.input",)),
    Mapping("system_prompt", ("completion", "prompt", "system"), fixed=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.completion")), optional=("$.system",)),
    Mapping("question_answer", ("answer", "question"), fixed=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping("messages", ("messages[].content", "messages[].role"), items=("$.messages", "$.role", "$.content"), roles=PEOPLE),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), items=("$.conversations", "$.from", "$.value"), roles=PEOPLE),
)


def canonical_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON text, comma-joined; null if it is no JSON.

    ``schema_of_variant`` prints a record's type with its fields in order of name; the
    scalar types are struck out, so that nulls and numbers don't change the layout.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(shape, r": (?:VOID|STRING|BIGINT|DOUBLE|BOOLEAN|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|UUID|DECIMAL\(\d+,\d+\))", "")
    return F.regexp_replace(shape, r"`", "")


def shape_of(paths: tuple[str, ...]) -> str:
    """What ``canonical_paths`` gives for records with just these paths (one level of arrays)."""
    top: dict[str, list[str]] = {}
    for path in paths:
        head, _, rest = path.partition("[].")
        top.setdefault(head, []).extend([rest] if rest else [])
    parts = [f"{k}: ARRAY<OBJECT<{', '.join(sorted(v))}>>" if v else k for k, v in sorted(top.items())]
    return f"OBJECT<{', '.join(parts)}>"


def fingerprint(record: Column) -> Column:
    """SHA-256 of the record's nested field paths."""
    return F.sha2(canonical_paths(record), 256)


def _which(record_print: Column, registry: tuple[Mapping, ...]) -> Column:
    """Name of the mapping that the fingerprint selects, or null."""
    out = F.lit(None).cast("string")
    for m in registry:
        out = F.when(record_print == F.sha2(F.lit(shape_of(m.paths)), 256), F.lit(m.name)).otherwise(out)
    return out


def _absent(optional: list[int]):
    return lambda x: ~(x["turn"].isin(optional) & (F.coalesce(x["text"], F.lit("")) == ""))


def to_turns(records: DataFrame, registry: tuple[Mapping, ...] = REGISTRY) -> DataFrame:
    """(conv_id, record string) rows to (conv_id, turn, role, text); unmapped records give none."""
    turn = "struct<turn:bigint,role:string,text:string>"
    known = records.select("conv_id", "record", _which(fingerprint(F.col("record")), registry).alias("layout"))
    made = F.lit(None).cast(f"array<{turn}>")
    variant = F.try_parse_json(F.col("record"))

    def get(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def item(m: Mapping):
        folded = F.create_map(*[F.lit(x) for kv in (m.roles or {"": ""}).items() for x in kv])

        def one(x: Column, i: Column) -> Column:
            role = get(x, m.items[1])
            return F.struct(i.cast("bigint").alias("turn"), F.coalesce(folded[role], role).alias("role"), get(x, m.items[2]).alias("text"))

        return one

    for m in registry:
        if m.row:
            one = F.array(F.struct(F.try_variant_get(variant, m.row[0], "bigint").alias("turn"), get(variant, m.row[1]).alias("role"), get(variant, m.row[2]).alias("text")))
        elif m.items:
            one = F.transform(F.try_variant_get(variant, m.items[0], "array<variant>"), item(m))
        else:
            one = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), get(variant, path).alias("text")) for i, (role, path) in enumerate(m.fixed)])
            if drop := [i for i, (_, path) in enumerate(m.fixed) if path in m.optional]:
                one = F.filter(one, _absent(drop))
        made = F.when(F.col("layout") == m.name, one.cast(f"array<{turn}>")).otherwise(made)
    return known.select("conv_id", F.explode(made).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")


def unmapped(records: DataFrame, registry: tuple[Mapping, ...] = REGISTRY) -> DataFrame:
    """Records that no mapping takes, with their fingerprints."""
    mark = fingerprint(F.col("record"))
    return records.withColumn("fingerprint", mark).filter(_which(mark, registry).isNull())


def escape(text: Column) -> Column:
    """Backslashes doubled, then one put behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to conv_id, formatted, loss_spans (start, length in code points).

    The turns of a conversation meet in one row, as that row is the result; nothing
    else is gathered. Offsets are running sums, so the work grows linearly.
    """
    from pyspark.sql import Window as W

    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = clean.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum(F.char_length("head") + F.char_length("body") + len(END)).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = parts.select(
        "conv_id", "role", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit(END)).alias("piece"),
        (end - len(END) - F.char_length("body")).alias("start"), F.char_length("body").alias("length"),
    )
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "piece", "start", "length"))).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["start"].cast("bigint").alias("start"), x["length"].cast("bigint").alias("length")))
    return rows.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def _turn(piece: Column) -> Column:
    halves = F.split(F.substring(piece, len(START) + 1, 2147483647), r"<\|message\|>", 2)
    return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the text under the loss mask, recovered from formatted rows."""
    pieces = F.split("formatted", r"<\|end\|>", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _turn)
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def records_of(rows: DataFrame) -> DataFrame:
    """A table with a turn in each row, as JSON records of the turn_row layout."""
    return rows.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    back = read_back(format_turns(to_turns(records_of(rows).unionByName(extra))))
    newline = F.lit("\n")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]'))
          + length(text) + len(regexp_extract_all(text, '\\|<\||</?s>|<</?SYS>>|\[/?INST\]')) + 27 AS n FROM r),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_text,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
