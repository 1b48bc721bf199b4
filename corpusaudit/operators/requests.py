"""Request tables for batch inference, inference with a caller's function, retries.

No model is shipped: a caller passes a function from prompts to replies. The
tables carry whole texts. Where a model takes no more than ``max_chars``, a
longer text is asked about in numbered pieces that together are the text, and
``merge_pieces`` joins the replies again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import paths, severity, text
from corpusaudit.functions.once import with_once
from corpusaudit.operators.files import assign_test_framework, language_by_content
from corpusaudit.operators.grouping import ROWS_PER_TASK, Keys, batches, key_list
from corpusaudit.operators.rules import with_language

# Temperature and output limit per task, and the reply shape.
TASKS = {
    "classify": (0.0, 16384, "classification"),
    "language": (0.0, 8192, "language"),
    "analyse": (0.0, 32768, "patterns"),
    "batch-analyse": (0.0, 32768, "batch"),
    "deep-analyse": (0.0, 16384, "analysis"),
    "security": (0.0, 8192, None),
    "refactor": (0.0, 8192, None),
    "transform": (0.2, 32768, None),
    "hints": (0.0, 16384, None),
    "docstrings": (0.0, 16384, None),
    "unit-tests": (0.2, 32768, None),
    "integration-tests": (0.2, 32768, None),
    "security-tests": (0.0, 32768, None),
    "performance-tests": (0.0, 32768, None),
}
CLASSIFY_BATCH = 25
ANALYSE_BATCH = 3
GROUP_BATCH = 5
#: Tasks whose replies about pieces of a text can be joined.
BY_PIECE = ["language", "analyse", "security", "refactor"]
MAX_PATTERNS_SINGLE = 10
MAX_PATTERNS_BATCH = 5

ASKS = {
    "classify": "Put each file into modernize_high, modernize_low or skip.",
    "language": "Name the language and the framework of this file.",
    "analyse": f"Report the {MAX_PATTERNS_SINGLE} most critical legacy patterns, a score and a priority.",
    "batch-analyse": f"Report the {MAX_PATTERNS_BATCH} most critical legacy patterns of each file.",
    "deep-analyse": "Describe the pattern, its issues, a recommendation, migration steps, risks and effort.",
    "security": "Report vulnerabilities with line numbers and a security score.",
    "refactor": "Suggest refactorings with category and priority, and a quality score.",
    "transform": "Apply the plan. Keep the behaviour. Return only the code.",
    "hints": "Add type hints. Return only the code.",
    "docstrings": "Add docstrings. Return only the code.",
    "unit-tests": "Write unit tests that hold for both versions.",
    "integration-tests": "Write integration tests for these files.",
    "security-tests": "Write tests for the listed vulnerabilities.",
    "performance-tests": "Write performance tests.",
}


def _prompt(task: str, *parts: Column) -> Column:
    return F.concat_ws("\n", F.lit(ASKS[task]), *parts)


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(value, F.lit("none")))


def _finish(df: DataFrame, task: str, file_paths: Column, prompt: Column) -> DataFrame:
    """The request table. Its id tells apart equal files of several repositories and the pieces of a file."""
    temperature, max_tokens, shape = TASKS[task]
    repo = (F.col("repo") if "repo" in df.columns else F.lit(None)).cast("string")
    numbers = [(F.col(c) if c in df.columns else F.lit(1)).cast("int").alias(c) for c in ("piece", "pieces", "first_line")]
    df = df.select(repo.alias("repo"), file_paths.alias("file_paths"), *numbers, prompt.alias("prompt"))
    own = F.to_json(F.struct(F.lit(task).alias("task"), "repo", "file_paths", "piece", "first_line"))
    return df.select(
        F.sha2(F.concat(own, F.lit("\n"), F.col("prompt")), 256).alias("request_id"),
        F.lit(task).alias("task"),
        "repo",
        "file_paths",
        "piece",
        "pieces",
        "first_line",
        "prompt",
        F.lit(temperature).alias("temperature"),
        F.lit(max_tokens).alias("max_tokens"),
        F.lit(shape).cast("string").alias("response_schema"),
    )


def in_pieces(files: DataFrame, max_chars: int | None) -> DataFrame:
    """Rows of at most ``max_chars`` characters of ``content``, with piece, pieces and the line that each begins on.

    The pieces of a file, in order, are its text; without a limit there is one.
    """
    content = F.coalesce("content", F.lit(""))
    if max_chars is None:
        return files.withColumns({"content": content, "piece": F.lit(1), "pieces": F.lit(1), "first_line": F.lit(1)})
    last = F.greatest(F.ceil(F.length(content) / max_chars).cast("int"), F.lit(1)) - 1
    texts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(content, i * max_chars + 1, F.lit(max_chars)))
    ends = F.transform(texts, lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))))
    cut = with_once(files, "cut", F.arrays_zip(texts.alias("text"), ends.alias("ends")))
    cut = cut.withColumn("pieces", F.size("cut"))
    # Line ends before a piece: a running sum over the pieces before it.
    start = F.aggregate(F.slice("cut.ends", 1, F.col("at")), F.lit(1), lambda a, b: a + b)
    return (
        cut.select("*", F.posexplode("cut").alias("at", "p"))
        .withColumns({"content": F.col("p.text"), "first_line": start, "piece": F.col("at") + 1})
        .drop("cut", "at", "p")
    )


def build_requests(files: DataFrame, task: str, max_chars: int | None = None) -> DataFrame:
    """One request per file, or per piece of it (columns file_path, content, repo if there are several, and what the task adds).

    ``transform`` reads a ``plan`` column, ``unit-tests`` ``modernized_code``,
    ``security-tests`` ``vulnerabilities`` (one text per file).
    """
    if max_chars is not None and task not in BY_PIECE:
        raise ValueError(f"{task!r} needs whole texts")
    path, content = F.col("file_path"), F.col("content")
    named = in_pieces(with_language(files), max_chars)
    language = _labelled("Language", F.col("language"))
    file_line = _labelled("File", path)
    if max_chars is not None:
        number = F.concat(F.lit(" (part "), F.col("piece").cast("string"), F.lit(" of "), F.col("pieces").cast("string"), F.lit(")"))
        file_line = F.concat(file_line, F.when(F.col("pieces") > 1, number).otherwise(""))
    if task == "language":
        parts = [file_line, language, content]
    elif task == "analyse":
        patterns = dims.lookup(F.col("language"), {k: "; ".join(v) for k, v in dims.LEGACY_PATTERNS.items()})
        parts = [file_line, language, _labelled("Patterns", patterns), content]
    elif task in ("security", "refactor"):
        parts = [file_line, content]
    elif task == "transform":
        parts = [file_line, _labelled("Plan", F.col("plan")), content]
    elif task in ("hints", "docstrings"):
        parts = [file_line, content]
    elif task in ("unit-tests", "security-tests", "performance-tests"):
        by_suffix = dims.language_of(paths.suffix(path), "tests")
        tested = F.coalesce(by_suffix, language_by_content(F.col("modernized_code") if task == "unit-tests" else content, "tests"))
        kind = {"unit-tests": "unit", "security-tests": "security", "performance-tests": "performance"}[task]
        named = assign_test_framework(named.withColumn("language", tested), kind)
        parts = [file_line, _labelled("Module", paths.stem(path)), language, _labelled("Framework", F.col("framework"))]
        if task == "unit-tests":
            parts += [content, F.col("modernized_code")]
        elif task == "security-tests":
            parts += [_labelled("Vulnerabilities", F.col("vulnerabilities")), content]
        else:
            parts += [content]
    else:
        raise ValueError(f"{task!r} is not a task for single files")
    return _finish(named, task, F.array(path), _prompt(task, *parts))


def build_batch_requests(
    files: DataFrame, task: str, size: int | None = None, rows_per_task: int = ROWS_PER_TASK, max_chars: int | None = None
) -> DataFrame:
    """Requests over contiguous batches of files per repository, in path order.

    ``classify`` sends paths only; ``batch-analyse`` sends whole files, and
    leaves batches of one file, and files above ``max_chars``, to the ``analyse``
    task, the latter in pieces.
    """
    size = size or {"classify": CLASSIFY_BATCH, "batch-analyse": ANALYSE_BATCH}[task]
    if task == "classify":
        numbered = batches(files.select("repo", "file_path"), size, ["file_path"], ["repo"], rows_per_task)
        grouped = numbered.groupBy("repo", "batch_id").agg(F.sort_array(F.collect_list(F.struct("file_path"))).alias("items"))
        return _finish(grouped, task, F.col("items.file_path"), _prompt(task, F.to_json("items.file_path")))
    wanted = with_language(files).select("repo", "file_path", "language", F.coalesce("content", F.lit("")).alias("content"))
    long = F.lit(False) if max_chars is None else F.length("content") > max_chars
    # Batches are numbered by path alone, so texts move once, to their batch.
    small = wanted.filter(~long)
    numbered = batches(small.select("repo", "file_path"), size, ["file_path"], ["repo"], rows_per_task)
    item = F.struct("file_path", "language", "content")
    grouped = (
        small.join(numbered, ["repo", "file_path"]).groupBy("repo", "batch_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    n = F.size("items")
    shown = F.transform("items", lambda f: F.concat_ws("\n", f["file_path"], f["language"], f["content"]))
    requests = _finish(grouped.filter(n > 1), task, F.col("items.file_path"), _prompt(task, F.array_join(shown, "\n\n")))
    alone = grouped.filter(n == 1).select("repo", F.col("items")[0]["file_path"].alias("file_path"), F.col("items")[0]["content"].alias("content"))
    requests = requests.unionByName(build_requests(alone, "analyse"))
    if max_chars is None:
        return requests
    return requests.unionByName(build_requests(wanted.filter(long).drop("language"), "analyse", max_chars))


def build_group_requests(
    groups: DataFrame, task: str, size: int = GROUP_BATCH, max_chars: int | None = None, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Requests over named groups of files (columns group_name, file_path, content, repo if there are several).

    All files of a group are shown, ``size`` to a request, in path order; a file
    above ``max_chars`` in pieces, each of which counts as one.
    """
    if task not in ("deep-analyse", "integration-tests"):
        raise ValueError(f"{task!r} is not a task for groups")
    cut = in_pieces(groups.withColumn("repo", F.col("repo") if "repo" in groups.columns else F.lit("")), max_chars)
    order = ["file_path", "repo", "piece"]
    numbered = batches(cut.select("group_name", *order), size, order, ["group_name"], rows_per_task)
    item = F.struct(*order, "pieces", "content")
    grouped = (
        cut.join(numbered, ["group_name", *order]).groupBy("group_name", "batch_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    number = lambda f: F.concat(F.lit(" (part "), f["piece"].cast("string"), F.lit(" of "), f["pieces"].cast("string"), F.lit(")"))
    shown = F.transform(
        "items", lambda f: F.concat(F.concat_ws("/", F.nullif(f["repo"], F.lit("")), f["file_path"]), F.when(f["pieces"] > 1, number(f)).otherwise(""), F.lit("\n"), f["content"])
    )
    prompt = _prompt(task, _labelled("Group", F.col("group_name")), F.array_join(shown, "\n\n"))
    parts = grouped.groupBy("group_name").agg(F.max("batch_id").alias("last"))
    made = grouped.join(parts, "group_name").select("items", "group_name", (F.col("batch_id") + 1).alias("piece"), (F.col("last") + 1).alias("pieces"))
    return _finish(made, task, F.col("items.file_path"), prompt)


def merge_pieces(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analyses of pieces (request_id, patterns, overall_priority, modernization_score, requires_modernization) as one per file.

    Patterns are put together, at the lines of the whole file and in order of
    the pieces; the most severe priority, the lowest score and any need count.
    """
    asked = requests.select("request_id", "repo", F.col("file_paths")[0].alias("file_path"), "piece", "first_line")
    moved = F.transform(
        "patterns", lambda p: p.withField("line_numbers", F.transform(p["line_numbers"], lambda n: n + F.col("first_line") - 1))
    )
    rows = asked.join(analyses, "request_id").withColumn("patterns", moved)
    ranked = F.struct(severity.rank(F.col("overall_priority")).alias("rank"), F.col("overall_priority"))
    return (
        rows.groupBy("repo", "file_path")
        .agg(
            F.sort_array(F.collect_list(F.struct("piece", "patterns"))).alias("parts"),
            F.max(ranked).alias("top"),
            F.min("modernization_score").alias("modernization_score"),
            F.bool_or("requires_modernization").alias("requires_modernization"),
        )
        .select(
            "repo", "file_path", F.flatten("parts.patterns").alias("patterns"), F.col("top.overall_priority").alias("overall_priority"),
            "modernization_score", "requires_modernization",
        )
    )


# -- inference ---------------------------------------------------------------
PredictFn = Callable[[Sequence[str]], Sequence[str]]
RESPONSES = "request_id string, response_text string, error string"


def batch_infer(requests: DataFrame, predict_fn: PredictFn, batch_size: int = 8) -> DataFrame:
    """Apply the caller's function to the prompts, ``batch_size`` at a time.

    A failing batch is halved until what fails is found, so one prompt that the
    function refuses is one error row and costs about twice the logarithm of the
    batch in further calls. A batch with the wrong number of replies fails too.
    """

    def answers(prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            replies = list(predict_fn(prompts))
            if len(replies) != len(prompts):
                raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
            return [(reply, None) for reply in replies]
        except Exception as problem:  # noqa: BLE001 - any failure of the caller's function
            if len(prompts) == 1:
                return [(None, str(problem))]
            half = len(prompts) // 2
            return answers(prompts[:half]) + answers(prompts[half:])

    def infer(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame["prompt"].tolist()
            found = [x for i in range(0, len(prompts), batch_size) for x in answers(prompts[i : i + batch_size])]
            yield pd.DataFrame({"request_id": frame["request_id"], "response_text": [r for r, _ in found], "error": [e for _, e in found]})

    return requests.select("request_id", "prompt").mapInPandas(infer, RESPONSES)


def transform_or_keep(files: DataFrame, replies: DataFrame, key: Keys = "file_path") -> DataFrame:
    """New text per file from the first code block; the original where there is no reply."""
    code = text.first_code_block(F.col("response_text"))
    return files.join(replies.select(*key_list(key), "response_text"), key_list(key), "left").withColumn(
        "modernized_code",
        F.when(F.col("response_text").isNotNull(), code).otherwise(F.col("content")),
    ).drop("response_text")


def route_failures(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Files asked for but not answered, and what to do with each.

    ``requests`` has request_id, file_path; ``responses`` the same for every file
    answered. A file of a batch is asked again alone; a single one falls back.
    """
    sizes = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("batch_size"))
    missing = requests.join(responses.select("request_id", "file_path").distinct(), ["request_id", "file_path"], "left_anti")
    return missing.join(sizes, "request_id").select(
        "request_id",
        "file_path",
        F.when(F.col("batch_size") > 1, "retry single").otherwise("fallback").alias("action"),
    )
