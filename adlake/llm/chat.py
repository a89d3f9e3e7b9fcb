"""Chat formatting: records of many layouts to canonical turns, a template and its loss mask.

Which nested fields a record fills is its schema; the hash of those field paths is its fingerprint.
Each known layout is a declarative mapping, found by the fingerprint of the paths it reads. All of it is
DataFrame expressions; a conversation is one row, and no step is more than linear in its turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: ``fixed`` (role, field) pairs, or an array ``each`` of role and text."""

    name: str
    fixed: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.each is None:
            return sorted(path for _, path in self.fixed)
        return sorted(f"{self.each}[].{x}" for x in (self.role, self.text))

    def turns(self) -> Column:
        if self.each is None:
            return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.col(path), F.lit("")).alias("text"))
                             for role, path in self.fixed])

        def turn(t: Column) -> Column:
            role = named = F.coalesce(t[self.role], F.lit(""))
            for theirs, ours in self.roles.items():
                named = F.when(role == theirs, F.lit(ours)).otherwise(named)
            return F.struct(named.alias("role"), F.coalesce(t[self.text], F.lit("")).alias("text"))

        return F.transform(self.each, turn)


MAPPINGS = (
    Mapping("prompt", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fixed=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("task", fixed=(("user", "instruction"), ("assistant", "output"))),
    Mapping("messages", each="messages"),
    Mapping("shared", each="conversations", role="from", text="value", roles={"human": "user", "gpt": "assistant"}),
)


def _leaves(kind: T.DataType, path: str) -> list[str]:
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType, f"{path}[]")
    return [path]


def _digest(paths: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(paths), "|"), 256)


def _filled(kind: T.DataType, path: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """Each leaf path below a field, with the test whether a value of the field fills it anywhere."""
    def inside(name: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda c: test(c[name])

    def anywhere(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda c: F.coalesce(F.exists(c, lambda e: test(e)), F.lit(False))

    if isinstance(kind, T.StructType):
        return [(p, inside(f.name, test)) for f in kind.fields for p, test in _filled(f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return [(p, anywhere(test)) for p, test in _filled(kind.elementType, f"{path}[]")]
    return [(path, lambda c: c.isNotNull())]


def fingerprint(records: DataFrame, ignore: tuple[str, ...] = (), read: frozenset[str] = frozenset()) -> Column:
    """Hash of the nested paths of a record's fields, but for the columns in ``ignore``.

    A path in ``read`` (what some mapping reads) counts where its column is not null, so that null or no
    texts do not change a layout; any other path counts where the record fills it, in whatever element.
    """
    none, found = F.array().cast("array<string>"), []
    for f in records.schema.fields:
        if f.name in ignore:
            continue
        leaves = _filled(f.dataType, f.name)
        plain = [F.lit(p) for p, _ in leaves if p in read]
        if plain:
            found.append(F.when(F.col(f.name).isNotNull(), F.array(*plain)).otherwise(none))
        found += [F.when(test(F.col(f.name)), F.array(F.lit(p))).otherwise(none) for p, test in leaves if p not in read]
    return _digest(F.concat(*found) if found else none)


def canonical(records: DataFrame, ignore: tuple[str, ...], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``ignore`` columns, ``fingerprint``, ``layout`` and ``turns``.

    A record whose fingerprint no mapping has is kept with null layout and turns. Null roles and
    texts inside a layout count as empty. Columns outside ``ignore`` are part of the schema; a field that
    no mapping reads, nested or not, only where it is filled.
    """
    have = {p for f in records.schema.fields for p in _leaves(f.dataType, f.name)}
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        if set(m.paths()) <= have:
            hit = F.col("fingerprint") == _digest(F.array(*[F.lit(p) for p in m.paths()]))
            layout = F.when(hit, F.lit(m.name)).otherwise(layout)
            turns = F.when(hit, m.turns().cast(TURNS)).otherwise(turns)
    marked = records.withColumn("fingerprint", fingerprint(records, ignore, frozenset(p for m in mappings for p in m.paths())))
    return marked.select(*ignore, "fingerprint", layout.alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    """Doubles backslashes, then parts ``<|``: no control string is left, and nothing is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    # a single backslash before n is a line break; doubled ones before it belong to themselves
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def formatted(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``turns`` with ``formatted`` and ``loss_mask``.

    The mask has one entry per turn, in code points: ``skip`` without loss, ``take`` with loss, then ``rest`` without.
    """
    def coded(t: Column) -> Column:
        return F.struct(_escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"),
                        (t["role"] == loss_role).alias("loss"))

    def mask(t: Column) -> Column:
        head = F.length(t["role"]) + len(START) + 1
        n, close = F.length(t["text"]), len(END)
        return F.struct(F.when(t["loss"], head).otherwise(head + n + close).alias("skip"),
                        F.when(t["loss"], n).otherwise(0).alias("take"),
                        F.when(t["loss"], F.lit(close)).otherwise(0).alias("rest"))

    text = F.array_join(F.transform(
        "__coded", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END))), "")
    return (turns.withColumn("__coded", F.transform("turns", coded))
            .withColumns({"formatted": text, "loss_mask": F.transform("__coded", mask)}).drop("__coded"))


def read_back(texts: DataFrame) -> DataFrame:
    """``texts`` with ``turns_back`` and ``loss_text``, read from ``formatted`` and ``loss_mask`` alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescaped_role(role).alias("role"),
                        unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    # a turn's text ends its part, so the masked characters are the part's last ones
    loss = F.array_join(F.zip_with("__parts", "loss_mask", lambda p, m: F.when(
        m["take"] > 0, unescaped(F.substr(p, m["skip"] + 1, m["take"]))).otherwise("")), "")
    return (texts.withColumn("__parts", parts)
            .withColumns({"turns_back": F.transform("__parts", turn), "loss_text": loss}).drop("__parts"))


def as_records(rows: DataFrame) -> DataFrame:
    """Conversations from rows (conv_id, turn, role, text), each in the leanest layout that holds it whole.

    Rows go by turn, then role and text, null first; null roles and texts are empty.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    turns = clean.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = turns.withColumn("roles", F.transform("t", lambda x: x["role"]))
    known = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))

    def is_(*roles: str) -> Column:
        return F.col("roles") == F.array(*[F.lit(r) for r in roles])

    layout = (F.when(is_("user", "assistant"), "prompt").when(is_("system", "user", "assistant"), "instruction")
              .when(known & (F.get("roles", F.lit(0)) == "user"), "shared").otherwise("messages"))

    def only(name: str, value: Column) -> Column:
        return F.when(F.col("layout") == name, value)

    def text(i: int) -> Column:
        return F.get("t", F.lit(i))["text"]

    return turns.withColumn("layout", layout).select(
        "conv_id", only("prompt", text(0)).alias("prompt"), only("prompt", text(1)).alias("completion"),
        only("instruction", text(0)).alias("instruction"), only("instruction", text(1)).alias("input"),
        only("instruction", text(2)).alias("output"),
        only("messages", F.transform("t", lambda x: F.struct(
            x["role"].alias("role"), x["text"].alias("content")))).alias("messages"),
        only("shared", F.transform("t", lambda x: F.struct(
            F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
            .alias("from"), x["text"].alias("value")))).alias("conversations"))
