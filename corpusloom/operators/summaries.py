"""Fact summaries of workbooks, C#, configuration and Angular files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import paths
from corpusloom.functions.jsontext import object_keys
from corpusloom.functions.strings import UNICODE, col, find_all, find_first, let, lines, strip

# Fixed value: what opens a macro module in a workbook text.
VBA_HEADER = "--- VBA Module:"

# Keyword groups of C# methods, first match wins, and what each is said to do.
CSHARP_METHODS = [
    (("AddHealthChecks",), "Registers health check endpoints for service monitoring."),
    (("AddServiceDiscovery",), "Integrates service discovery into the DI container."),
    (("AddLogging",), "Configures application logging (console, debug)."),
    (("UseRouting", "UseHealthChecks"), "Sets up middleware for routing and health check endpoints."),
    (
        ("AddDefaultConfiguration",),
        "Loads configuration from JSON files and environment variables.",
    ),
]
# Words that are taken out of what is said of C# methods, and how such methods are found.
CSHARP_SCRUB = ["macro", "xlsm", "Excel", "sheet"]
CSHARP_METHOD = r"public\s+static\s+[\w<>,\[\]]+\s+(\w+)\s*\(([^\)]*)\)\s*\{[\s\S]*?\}"

# Fixed value: the request lines that count.
HTTP_METHODS = "GET|POST|PUT|DELETE|PATCH"
TOP_TAGS = 5


def vba_modules(text: Column | str) -> Column:
    """``array<struct<module, parameters, comments, logic>>``.

    A module runs from its header line to the next one. A repeated name
    stands where it first was, with its last body. Modules without a name or
    lines are left out.
    """
    blocks = F.split(
        F.concat(F.lit("\n"), F.array_join(lines(text), "\n")), rf"\n(?=(?U:[^\S\n])*{VBA_HEADER})"
    )
    blocks = F.transform(
        F.filter(blocks, lambda b: strip(b).startswith(VBA_HEADER)),
        lambda b: F.struct(
            strip(
                F.replace(F.element_at(F.split(b, "\n"), 1), F.lit(VBA_HEADER), F.lit(""))
            ).alias("module"),
            F.slice(F.split(b, "\n"), F.lit(2), F.size(F.split(b, "\n"))).alias("rows"),
        ),
    )
    blocks = F.filter(blocks, lambda b: (b["module"] != "") & (F.size(b["rows"]) > 0))
    sub = r"(?idU)\bSub\s+(\w+)\s*\((.*?)\)"

    def module(name: Column, rows: Column) -> Column:
        headers = F.filter(rows, lambda r: r.rlike(sub))
        remarks = F.filter(rows, lambda r: r.contains("'"))
        return F.struct(
            name.alias("module"),
            F.array_join(
                F.transform(
                    headers,
                    lambda r: F.concat(
                        F.regexp_extract(r, sub, 1), F.lit("("), F.regexp_extract(r, sub, 2), F.lit(")")
                    ),
                ),
                ", ",
            ).alias("parameters"),
            F.array_join(
                F.transform(remarks, lambda r: strip(r.substr(F.locate("'", r) + 1, F.length(r)))), "\n"
            ).alias("comments"),
            F.array_join(rows, "\n").alias("logic"),
        )

    def modules(found: Column) -> Column:
        # sorted by name, the first and the last of each name stand next to another one
        placed = F.transform(
            found, lambda b, i: F.struct(b["module"].alias("module"), i.alias("i"), b["rows"].alias("rows"))
        )

        def ends(ranked: Column, step: int) -> Column:
            def is_end(b: Column, k: Column) -> Column:
                return ~F.get(ranked, k + step)["module"].eqNullSafe(b["module"])

            return F.filter(ranked, is_end)

        def one_each(ranked: Column) -> Column:
            pairs = F.zip_with(
                ends(ranked, -1),
                ends(ranked, 1),
                lambda first, last: F.struct(first["i"].alias("i"), last["module"].alias("module"), last["rows"].alias("rows")),
            )
            return F.transform(F.array_sort(pairs), lambda b: module(b["module"], b["rows"]))

        return let(F.array_sort(placed), one_each)

    return let(blocks, modules)


def vba_procedures(text: Column | str) -> Column:
    """``array<struct<kind, name, parameters, comments>>`` of a module's Subs and Functions.

    Comments are the comment lines among the three lines before the header.
    """
    header = r"(?idU)\b(Sub|Function)\s+(\w+)\s*\((.*?)\)"

    def procedure(r: Column, rows: Column) -> Column:
        first = F.greatest(r["at"] - 2, F.lit(1))
        before = F.slice(rows, first, r["at"] + 1 - first)
        remarks = F.filter(F.transform(before, strip), lambda x: x.startswith("'"))
        return F.struct(
            F.regexp_extract(r["row"], header, 1).alias("kind"),
            F.regexp_extract(r["row"], header, 2).alias("name"),
            F.regexp_extract(r["row"], header, 3).alias("parameters"),
            F.when(F.size(remarks) > 0, F.array_join(remarks, " "))
            .otherwise("[No comments]")
            .alias("comments"),
        )

    def procedures(rows: Column) -> Column:
        numbered = F.transform(rows, lambda r, i: F.struct(r.alias("row"), i.alias("at")))
        headers = F.filter(numbered, lambda r: r["row"].rlike(header))
        return F.transform(headers, lambda r: procedure(r, rows))

    return let(lines(text), procedures)


def workbook_summary(text: Column | str) -> Column:
    """Macros, formulas, validations, formatting, names, pivots and links, in that order."""
    found = let(lines(text), lambda rows: F.concat(_macro_lines(text), _workbook_facts(rows)))
    return let(
        found,
        lambda facts: F.when(F.size(facts) > 0, F.array_join(facts, "\n")).otherwise(
            "No business logic, rules, or automation found in the file."
        ),
    )


def _macro_lines(text: Column | str) -> Column:
    return F.flatten(
        F.transform(
            vba_modules(text),
            lambda m: F.array(
                F.concat(F.lit("Macro: "), m["module"]),
                F.concat(F.lit("Parameters: "), m["parameters"]),
                F.concat(F.lit("Comments: "), m["comments"]),
                F.concat(F.lit("Logic: "), m["logic"]),
            ),
        )
    )


def _workbook_facts(rows: Column) -> Column:
    formula = r"(?dU)^FORMULA: ([A-Z]+\d+) = (.+)"

    def labelled(prefix: str, label: str) -> Column:
        hits = F.filter(rows, lambda r: strip(r).startswith(prefix))
        return F.transform(
            hits, lambda r: F.concat(F.lit(label), strip(F.replace(strip(r), F.lit(prefix), F.lit(""))))
        )

    formulas = F.transform(
        F.filter(rows, lambda r: r.rlike(formula)),
        lambda r: F.concat(
            F.lit("Formula in "), F.regexp_extract(r, formula, 1), F.lit(": "), F.regexp_extract(r, formula, 2)
        ),
    )
    names = F.transform(
        F.filter(rows, lambda r: strip(r).startswith("- ") & r.contains(":")),
        lambda r: F.concat(F.lit("Named Range: "), strip(r)),
    )
    pivots = F.transform(
        F.filter(rows, lambda r: strip(r).startswith("Pivot Tables in") | strip(r).startswith("- Name:")),
        strip,
    )
    links = F.transform(F.filter(rows, lambda r: strip(r).startswith("External Link:")), strip)
    return F.concat(
        formulas,
        labelled("DATA_VALIDATION:", "Data Validation Rule: "),
        labelled("CONDITIONAL_FORMATTING:", "Conditional Formatting: "),
        names,
        pivots,
        links,
    )


def csharp_summary(text: Column | str) -> Column:
    text = col(text)
    name = F.coalesce(find_first(text, r"class\s+(\w+)", 1), F.lit("UnknownClass"))
    blocks = find_all(text, CSHARP_METHOD, 0)
    signature = UNICODE + r"^public\s+static\s+[\w<>,\[\]]+\s+(\w+)\s*\(([^\)]*)\)"

    def describe(block: Column) -> Column:
        method = F.regexp_extract(block, signature, 1)
        plain = F.concat(
            F.lit("- '"), method, F.lit("("), F.regexp_extract(block, signature, 2),
            F.lit(")': Extension method for ASP.NET Core services."),
        )
        out = None
        for words, purpose in CSHARP_METHODS:
            hit = block.contains(words[0])
            for word in words[1:]:
                hit = hit | block.contains(word)
            said = F.concat(F.lit("- '"), method, F.lit(f"': {purpose}"))
            out = F.when(hit, said) if out is None else out.when(hit, said)
        return out.otherwise(plain)

    methods = F.when(F.size(blocks) > 0, F.transform(blocks, describe)).otherwise(
        F.array(F.lit("- No extension methods detected."))
    )
    summary = F.concat_ws(
        "\n",
        F.concat(
            F.lit("This file defines the '"), name,
            F.lit(
                "' static class, providing extension methods to streamline service and middleware "
                "configuration in ASP.NET Core applications."
            ),
        ),
        F.lit("Key functionalities include:"),
        methods,
    )
    for word in CSHARP_SCRUB:
        summary = F.replace(summary, F.lit(word), F.lit(""))
    return F.regexp_replace(summary, r"(?m)^[ \t]+$", "")


def _listing(label: str, items: Column) -> Column:
    return F.concat(F.lit(label), F.array_join(items, ", "), F.lit("."))


def config_summary(text: Column | str, path: Column | str) -> Column:
    """Project, solution, JSON, YAML and request files."""
    text, ext = col(text), paths.extension(path)
    refs = find_all(text, '<ProjectReference Include="([^"]+)"', 1)
    package = '<PackageReference Include="([^"]+)" Version="([^"]+)"'
    packages = F.zip_with(
        find_all(text, package, 1),
        find_all(text, package, 2),
        lambda n, v: F.concat(n, F.lit(" ("), v, F.lit(")")),
    )
    project = F.concat_ws(
        "\n",
        F.when(
            F.size(refs) > 0, F.concat(F.lit("Project References: "), F.array_join(refs, ", "))
        ).otherwise("No project references detected."),
        F.when(
            F.size(packages) > 0, F.concat(F.lit("NuGet Packages: "), F.array_join(packages, ", "))
        ),
    )
    rows = lines(text)
    yaml_keys = F.transform(
        F.filter(rows, lambda r: r.contains(":") & ~strip(r).startswith("#")),
        lambda r: strip(F.substring_index(r, ":", 1)),
    )
    endpoints = F.filter(rows, lambda r: strip(r).rlike(f"^({HTTP_METHODS})"))
    projects = find_all(text, r'Project\("\{[^}]+\}"\) = "([^"]+)",', 1)
    return (
        F.when(ext == ".csproj", project)
        .when(
            ext == ".json",
            F.coalesce(
                _listing("JSON config file; top-level keys: ", object_keys(text)),
                F.lit("JSON config file; unable to parse."),
            ),
        )
        .when(
            ext.isin(".yml", ".yaml"),
            _listing("YAML config file; top-level keys: ", F.slice(yaml_keys, 1, 10)),
        )
        .when(ext == ".http", _listing("HTTP file; endpoints: ", F.slice(endpoints, 1, 5)))
        .when(ext == ".sln", _listing("Solution file; projects: ", projects))
        .otherwise(F.concat(F.lit(".NET config file: "), paths.file_name(path), F.lit(".")))
    )


def decorators(text: Column | str) -> Column:
    return F.array_distinct(find_all(text, r"@(Component|Injectable|NgModule)\s*\(", 1))


def class_names(text: Column | str) -> Column:
    return find_all(text, r"class\s+(\w+)", 1)


def selectors(text: Column | str) -> Column:
    return find_all(text, r"""selector:\s*['"]([\w-]+)['"]""", 1)


def angular_summary(text: Column | str, path: Column | str) -> Column:
    """Summary of ``.ts`` and ``.json`` files; ``.html`` is done by ``html_summary``."""
    text, ext = col(text), paths.extension(path)

    def part(label: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, _listing(label, items))

    script = F.nullif(
        F.concat_ws(
            " ",
            part("Decorators: ", decorators(text)),
            part("Classes: ", class_names(text)),
            part("Selectors: ", selectors(text)),
        ),
        F.lit(""),
    )
    return (
        F.when(
            ext == ".ts",
            F.coalesce(script, F.lit("Angular TypeScript file; no decorators or classes detected.")),
        )
        .when(
            ext == ".json",
            F.coalesce(
                _listing("Angular JSON config; top-level keys: ", object_keys(text)),
                F.lit("Angular JSON config file; unable to parse."),
            ),
        )
        .otherwise(F.concat(F.lit("Angular file: "), paths.file_name(path), F.lit(".")))
    )


def top_tags(pages: DataFrame, keys: list[str], html: str = "html", n: int = TOP_TAGS) -> DataFrame:
    """The most frequent tags of each page; ties by first appearance."""
    tags = pages.select(*keys, F.posexplode(find_all(html, r"<([a-zA-Z0-9_-]+)", 1)).alias("_pos", "tag"))
    counts = tags.groupBy(*keys, "tag").agg(
        F.count(F.lit(1)).alias("uses"), F.min("_pos").alias("_first")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("uses"), "_first"))
    return counts.withColumn("place", place).where(F.col("place") <= n).drop("_first")


def html_summary(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One line per page with its main tags."""
    ranked = top_tags(pages, keys, html).groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("place", "tag"))), lambda t: t["tag"]
        ).alias("_tags")
    )
    out = pages.select(*keys).join(ranked, keys, "left")
    tags = F.coalesce("_tags", F.array().cast("array<string>"))
    return out.select(*keys, _listing("HTML template file; main tags: ", tags).alias("summary"))


def technical_summary(files: DataFrame, keys: list[str], path: str = "rel_path", text: str = "text") -> DataFrame:
    """The summary that fits each file's extension; null where there is none."""
    ext = paths.extension(path)
    in_row = (
        F.when(ext.isin(".ts", ".js", ".jsx", ".tsx"), angular_summary(text, path))
        .when(ext == ".cs", csharp_summary(text))
        .when(
            ext.isin(".csproj", ".sln", ".json", ".yml", ".yaml", ".http"), config_summary(text, path)
        )
        .when(ext == ".sql", F.lit("SQL file; summary utility not implemented."))
        .when(paths.is_workbook(path), workbook_summary(text))
    )
    html = ext == ".html"
    plain = files.where(~html).select(*keys, in_row.alias("summary"))
    return plain.unionByName(html_summary(files.where(html), keys, text))
