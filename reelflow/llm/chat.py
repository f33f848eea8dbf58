"""Chat formatting with a grammar round trip, in column expressions only.

A turn is an opening mark, a text and a closing mark; the marks depend on the role, and any other
role is named in its opening mark. The parser reads a formatted conversation from left to right: an
opening mark, then the shortest text up to the closing mark of that role; then it resolves
the escapes `&lt;` `&lsqb;` `&vert;` `&amp;`. A conversation is formatted raw and parsed. If the
turns differ from the source, the texts that do not come back alone are escaped, and if the turns
still differ, all texts are; the result is checked, and a conversation that does not come back
is an error. The loss mask covers the texts of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_END = "<|end|>"
TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|<\|[^|]*\|>.*?<\|end\|>"
#: Escapes in the order of writing; they are resolved in reverse. A bar is escaped in role names only.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
BAR = ("|", "&vert;")


def escape(text: Column, *more: tuple[str, str]) -> Column:
    for plain, written in (*ESCAPES, *more):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in (BAR, *reversed(ESCAPES)):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _by_role(role: Column, at: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[at])).otherwise(out)
    return out


def rendered(role: Column, text: Column) -> Column:
    """One formatted turn; `text` is escaped already or raw."""
    named = F.concat(F.lit("<|"), escape(role, BAR), F.lit("|>"))
    return F.concat(_by_role(role, 0, named), text, _by_role(role, 1, F.lit(OTHER_END)))


def segments(formatted: Column) -> Column:
    """The turns of a formatted text as (role, opening length, written text), in order."""

    def parts(s: Column) -> Column:
        role, opened = F.regexp_extract(s, r"^<\|([^|]*)\|>", 1), F.length(F.regexp_extract(s, r"^<\|[^|]*\|>", 0))
        role, closed = unescape(role), F.lit(len(OTHER_END))
        for name, (a, b) in MARKS.items():
            here = F.startswith(s, F.lit(a))
            role, opened, closed = (F.when(here, F.lit(x)).otherwise(y) for x, y in ((name, role), (len(a), opened), (len(b), closed)))
        written = F.substring(s, opened + 1, F.length(s) - opened - closed)
        return F.struct(role.alias("role"), opened.alias("opened"), F.length(s).alias("size"), written.alias("written"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parts)


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text as (role, text)."""
    return F.transform(segments(formatted), lambda s: F.struct(s["role"].alias("role"), unescape(s["written"]).alias("text")))


def _joined(turns: Column, text: object) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], text(t))), "")


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss): one row for each conversation.

    `turns` are those read back from `formatted`; `loss` holds (start, end), in code points of
    `formatted`, of each assistant text. Reads `conv_id`, `turn`, `role`, `text`; other columns may
    have any name. Turns stand by number, equal numbers by role and text; a null number comes first.
    Null text or role is empty; rows without a conv_id are one conversation. Repeated rows are
    repeated turns. An empty table gives an empty result.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("s"))
    source = grouped.select("conv_id", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def back(t: Column) -> Column:
        return parsed(rendered(t["role"], t["text"])) == F.array(t)

    own = F.col("source")
    levels = [
        _joined(own, lambda t: t["text"]),
        _joined(own, lambda t: F.when(back(t), t["text"]).otherwise(escape(t["text"]))),
        _joined(own, lambda t: escape(t["text"])),
    ]
    out = source.withColumn("formatted", levels[0]).withColumn("turns", parsed(F.col("formatted")))
    for level in levels[1:]:
        out = out.withColumn("same", F.col("turns") == own)
        out = out.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(level))
        out = out.withColumn("turns", F.when(F.col("same"), F.col("turns")).otherwise(parsed(F.col("formatted"))))
    checked = F.when(F.col("turns") == own, F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not come back")))
    out = out.select("conv_id", "formatted", checked.alias("turns")).withColumn("parts", segments(F.col("formatted")))
    before = lambda k: F.aggregate(F.slice("parts", F.lit(1), k), F.lit(0), lambda n, s: n + s["size"])
    spans = F.transform("parts", lambda s, k: F.struct(
        s["role"].alias("role"), (before(k) + s["opened"]).alias("start"), (before(k) + s["opened"] + F.length(s["written"])).alias("end")))
    loss = F.transform(F.filter(spans, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return out.select("conv_id", "formatted", "turns", loss.alias("loss"))


def digests(done: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    out = done.withColumn("masked", F.array_join(masked, ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle_sql() -> str:
    """The same in SQL: a text is escaped if it holds its closing mark or something that reads as an escape."""
    size = {r: len(a) + len(b) for r, (a, b) in MARKS.items()}
    return f"""
        with turns as (
            select conv_id, turn, role, text from conversations
            union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        texts as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from turns),
        marked as (
            select *, contains(text, case role when 'system' then '<</SYS>>' when 'user' then '[/INST]' when 'assistant' then '</s>' else '<|end|>' end)
                or regexp_matches(text, '&(amp|lt|lsqb|vert);') as conflicting
            from texts)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(case role when 'system' then {size["system"]} when 'user' then {size["user"]} when 'assistant' then {size["assistant"]} else 11 + length(role) end
                + case when conflicting then length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) else length(text) end)::bigint as formatted_chars
        from marked group by conv_id"""
