"""Merging the sectioned outputs of a file's chunks into one text per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import sections as S
from corpusloom.functions.strings import col, strip
from corpusloom.functions.tokens import MAX_SAFE_TOKENS, MAX_SECTION_TOKENS, token_count
from corpusloom.session import cut_lineage

from .skew import first_rows, salted_join

# Token budget of each combined section, and functionalities kept.
SECTION_BUDGETS = {
    "Overview": MAX_SECTION_TOKENS,
    "Objective": MAX_SECTION_TOKENS // 2,
    "Use Case": MAX_SECTION_TOKENS // 2,
    "Workflow Summary": MAX_SECTION_TOKENS // 2,
}
MAX_FUNCTIONALITIES = 10

# Sentences of a group looked at per round.
ROUND_SENTENCES = 5_000

# Headers a requirements text is split at for the project context,
# the parts shown per file, and the text for a project without content.
CONTEXT_HEADERS = [*S.HEADERS, "Technical Requirements", "Business Logic"]
CONTEXT_PARTS = [
    ("Overview", "Overview"), ("Objective", "Objective"),
    ("Key Functions", "Key Functionalities"), ("Use Case", "Use Case"),
]
WORKFLOW_TITLE = "WORKFLOW SUMMARIES:\n"
CONTEXT_TITLE = "ADDITIONAL FILE CONTEXT:\n"
NO_CONTENT = (
    "Project analysis completed with limited information available for comprehensive summary generation."
)


def greedy_fold(items: Column | str, used: Column, budget: Column) -> Column:
    """Take each sentence that still fits; leave out one that does not and go on.

    ``items`` is ``array<struct<tokens, sentence, ...>>`` in order. Result:
    ``struct<used, kept>``. Nothing is taken once the budget is used up.
    """
    start = F.struct(used.cast("int").alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        fits = (acc["used"] < budget) & (acc["used"] + item["tokens"] <= budget)
        return F.when(
            fits,
            F.struct(
                (acc["used"] + item["tokens"]).cast("int").alias("used"),
                F.concat(acc["kept"], F.array(item["sentence"])).alias("kept"),
            ),
        ).otherwise(acc)

    return F.aggregate(col(items), start, step)


def greedy_text(text: Column | str, budget: int) -> Column:
    """The budgeted sentences of one text, joined by a space."""
    parts = F.transform(S.sentences(text), strip)
    items = F.transform(
        F.filter(parts, lambda s: s != ""),
        lambda s: F.struct(token_count(s).alias("tokens"), s.alias("sentence")),
    )
    return F.array_join(greedy_fold(items, F.lit(0), F.lit(budget))["kept"], " ")


def budget_sentences(
    sentences: DataFrame,
    group: list[str],
    by: list[str],
    round_sentences: int = ROUND_SENTENCES,
    unless_overlong: bool = False,
) -> DataFrame:
    """Greedy sentence budget per group, for groups of any size.

    ``sentences`` has ``sentence, tokens, budget`` and is ordered by ``by``.
    A round takes the next few thousand sentences of each group that can
    still fit, folds them in order and notes what is left. Sentences too
    large for what is left can never fit later, so the following rounds see
    only small ones; groups that are through drop out. No round holds more
    than ``round_sentences`` of a group. Result: ``group, used, kept``.

    Sentences of a few characters count as no tokens and are taken as long as
    the budget is not used up, however many there are. With
    ``unless_overlong`` a group may end once its joined text is longer than
    the budget allows, for callers that then do not use the text.
    """
    position = F.struct(*by)
    todo = cut_lineage(sentences.select(*group, position.alias("_at"), "sentence", "tokens", "budget"))
    done: DataFrame | None = None
    state: DataFrame | None = None
    while True:
        ask = todo
        if state is not None:
            ask = salted_join(todo, state.select(*group, "_last", "used"), group).where(
                (F.col("_at") > F.col("_last")) & (F.col("used") + F.col("tokens") <= F.col("budget"))
            )
        else:
            ask = ask.where(F.col("tokens") <= F.col("budget")).withColumn("used", F.lit(0))
        few = first_rows(ask, group, ["_at"], round_sentences + 1)
        lists = few.groupBy(*group, "budget", "used").agg(
            F.array_sort(F.collect_list(F.struct("_at", "tokens", "sentence"))).alias("_items")
        )
        now = F.slice("_items", 1, round_sentences)
        folded = lists.withColumn("_fold", greedy_fold(now, F.col("used"), F.col("budget"))).select(
            *group,
            "budget",
            F.col("_fold.used").alias("used"),
            F.col("_fold.kept").alias("kept"),
            F.element_at(now, -1)["_at"].alias("_last"),
            (F.size("_items") > round_sentences).alias("_more"),
        )
        folded = cut_lineage(folded)
        done = folded if done is None else done.unionByName(folded)
        full = F.col("used") >= F.col("budget")
        if unless_overlong:  # joined by spaces, so many are over the budget together
            full = full | (F.size("kept") > 4 * F.col("budget") + 4)
        state = folded.where(F.col("_more") & ~full)
        if state.isEmpty():
            break
    rounds = F.array_sort(F.collect_list(F.struct("_last", "kept")))
    return done.groupBy(*group).agg(
        F.max("used").alias("used"),
        F.flatten(F.transform(rounds, lambda r: r["kept"])).alias("kept"),
    )


def merge_functionalities(
    chunks: DataFrame, keys: list[str], text: str = "key_text", index: str = "chunk_index"
) -> DataFrame:
    """The first ten different functionalities of each file, numbered from 1.

    Repeats go in a partial aggregation and the ranking keeps ten rows per
    file on each task, so a file with very many chunks sends little.
    """
    items = chunks.select(
        *keys, F.col(index).alias("_chunk"), F.posexplode(S.numbered_items(text)).alias("_pos", "item")
    )
    first = items.groupBy(*keys, "item").agg(F.min(F.struct("_chunk", "_pos")).alias("_at"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))
    return (
        first.withColumn("number", number)
        .where(F.col("number") <= MAX_FUNCTIONALITIES)
        .select(*keys, "number", "item")
    )


def complete_chunks(
    chunks: DataFrame, keys: list[str], text: str = "text", index: str = "chunk_index"
) -> DataFrame:
    """Chunk outputs with all five sections, one column per section."""
    out = chunks.select(
        *keys, F.col(index).alias("chunk_index"), S.sections_loose(text).alias("_s")
    ).select(*keys, "chunk_index", "_s.*")
    return out.dropna(subset=[S.slug(h) for h in S.CHUNK_HEADERS])


def combine_sections(
    chunks: DataFrame,
    keys: list[str],
    text: str = "text",
    index: str = "chunk_index",
    language: str = "language",
) -> DataFrame:
    """One requirements text per file from the outputs of its chunks.

    Section texts that repeat count once, in the order of their first chunk;
    each chunk's text ends its last sentence. An empty or overlong section
    gets its default. Functionalities are merged and renumbered.
    """
    languages = chunks.groupBy(*keys).agg(F.min(language).alias("_language"))
    whole = cut_lineage(complete_chunks(chunks, keys, text, index))
    item = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("section"), F.lit(b).alias("budget"), F.col(S.slug(h)).alias("item")
                )
                for h, b in SECTION_BUDGETS.items()
            ]
        )
    )
    items = whole.select(*keys, "chunk_index", item.alias("_s")).select(*keys, "chunk_index", "_s.*")
    items = (
        items.where(F.col("item") != "")
        .groupBy(*keys, "section", "budget", "item")
        .agg(F.min("chunk_index").alias("chunk_index"))
    )
    sentence = items.select(
        *keys,
        "section",
        "budget",
        "chunk_index",
        F.posexplode(F.transform(S.sentences("item"), strip)).alias("pos", "sentence"),
    ).where(F.col("sentence") != "")
    kept = budget_sentences(
        sentence.withColumn("tokens", token_count("sentence")),
        [*keys, "section"],
        ["chunk_index", "pos"],
        unless_overlong=True,  # such a section gets its default
    )
    texts = kept.groupBy(*keys).pivot("section", list(SECTION_BUDGETS)).agg(
        F.first(F.array_join("kept", " "))
    )
    functions = merge_functionalities(whole, keys, S.slug("Key Functionalities"))
    listed = functions.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("number", "item"))),
                lambda f: F.concat(f["number"].cast("string"), F.lit(". "), f["item"]),
            ),
            "\n\n",
        ).alias("_functions")
    )
    files = languages.join(texts, keys, "left").join(listed, keys, "left")
    defaults = S.combined_defaults(F.col("_language"))

    def section(name: str) -> Column:
        body = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        bad = (body == "") | (token_count(body) > SECTION_BUDGETS[name])
        return F.concat(F.lit(f"{name}\n"), F.when(bad, defaults[name]).otherwise(body))

    functions_part = F.when(
        F.col("_functions").isNotNull(), F.concat(F.lit("Key Functionalities\n"), "_functions")
    )
    return files.select(
        *keys,
        F.concat_ws(
            "\n\n",
            section("Overview"),
            section("Objective"),
            section("Use Case"),
            functions_part,
            section("Workflow Summary"),
        ).alias("requirements"),
    )


def project_context(
    results: DataFrame,
    keep: tuple[str, ...] = ("project_id",),
    order: str = "rel_path",
    max_tokens: int = MAX_SAFE_TOKENS,
) -> DataFrame:
    """The text a project summary is written from: workflows, then file parts.

    Texts over the limit keep their first part, so never more than the limit
    is needed. The total length is a plain sum; only rows that start inside
    the limit are brought together. Every project has a row: one whose files
    show no part has the bare title, and one without any text a fixed sentence.
    """
    limit = 4 * max_tokens + 4
    parts = results.where(F.col("requirements") != "").select(
        *keep,
        F.col(order).alias("_order"),
        "file_name",
        S.sections_strict("requirements", CONTEXT_HEADERS).alias("_s"),
    ).select(*keep, "_order", "file_name", "_s.*")
    flow = F.col("workflow_summary")
    flow_line = F.when(
        F.coalesce((flow != "") & ~flow.startswith("Error"), F.lit(False)),
        F.concat("file_name", F.lit(": "), flow, F.lit("\n")),
    )
    shown = [F.nullif(F.col(S.slug(h)), F.lit("")) for _, h in CONTEXT_PARTS]
    lines = [
        F.concat(F.lit(f"  {label}: "), part, F.lit("\n"))
        for (label, _), part in zip(CONTEXT_PARTS, shown)
    ]
    block = F.when(
        F.coalesce(*shown[:3]).isNotNull(),
        F.concat(F.lit("\n"), "file_name", F.lit(":\n"), F.concat_ws("", *lines)),
    )
    rows = parts.select(
        *keep,
        "_order",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_part"), flow_line.alias("line")),
                F.struct(F.lit(1).alias("_part"), block.alias("line")),
            )
        ),
    ).where(F.col("line").isNotNull())
    flows = F.coalesce(F.max(F.when(F.col("_part") == 0, 1)), F.lit(0))
    totals = rows.groupBy(*keep).agg(
        F.sum(F.length("line")).alias("_chars"), flows.alias("_flows")
    )
    window = Window.partitionBy(*keep).orderBy("_part", "_order")
    # every line has at least four characters
    cut_lines = rows.withColumn("line", F.substring("line", 1, limit))
    near = first_rows(cut_lines, [*keep], ["_part", "_order"], limit // 4 + 1)
    start = F.coalesce(
        F.sum(F.length("line")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    near = near.withColumn("_start", start).where(F.col("_start") < limit)
    joined = near.groupBy(*keep).agg(
        F.array_sort(F.collect_list(F.struct("_part", "_order", "line"))).alias("_lines")
    )

    def of(part: int) -> Column:
        mine = F.filter("_lines", lambda x: x["_part"] == part)
        return F.array_join(F.transform(mine, lambda x: x["line"]), "")

    head = F.when(F.col("_flows") > 0, F.concat(F.lit(WORKFLOW_TITLE), of(0), F.lit("\n")))
    text = F.concat(F.coalesce(head, F.lit("")), F.lit(CONTEXT_TITLE), of(1))
    frame = F.lit(len(CONTEXT_TITLE)) + F.when(
        F.col("_flows") > 0, F.lit(len(WORKFLOW_TITLE) + 1)
    ).otherwise(F.lit(0))
    tokens = F.floor((F.col("_chars") + frame) / 4)
    cut = F.when(tokens > max_tokens, F.substring(text, 1, max_tokens * 3 // 4)).otherwise(text)
    shown_projects = joined.join(totals, [*keep]).select(*keep, tokens.alias("tokens"), cut.alias("context"))
    projects = results.groupBy(*keep).agg(F.max(F.coalesce(F.col("requirements") != "", F.lit(False))).alias("_any"))
    other = F.when(F.col("_any"), F.lit(CONTEXT_TITLE)).otherwise(F.lit(NO_CONTENT))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keep]
    return projects.alias("p").join(shown_projects.alias("s"), same, "left").select(
        *[f"p.{c}" for c in keep],
        F.coalesce("s.tokens", F.floor(F.length(other) / 4)).alias("tokens"),
        F.coalesce("s.context", other).alias("context"),
    )
