"""Audit of cited answers: markers, citation overlap, evidence passages, splits, context rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundtable.operators.chunking import strip

# Words that say nothing about a claim, for citation overlap and for evidence.
CLAIM_STOPWORDS = (
    "the a an and or but if then than that this these those is are was were be "
    "been being do does did have has had of in on at by for with about from to as it its their they them "
    "you your we our can could should would may might must will shall not no so such into over under"
).split()
EVIDENCE_STOPWORDS = "this that with from have does into your when then only they their should would could".split()


def without_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", " "), r"`[^`]*`", " ")


def paragraphs(answers: DataFrame) -> DataFrame:
    """(answer_id, para, paragraph) of answers without fenced code."""
    parts = F.split(F.regexp_replace("answer_md", r"(?s)```.*?```", " "), r"\n\s*\n")
    return answers.select("answer_id", F.posexplode(F.filter(F.transform(parts, strip), lambda p: p != "")).alias("para", "paragraph"))


def citation_marks(answers: DataFrame) -> DataFrame:
    """A2: one row per paragraph and cited number."""
    marks = F.regexp_extract_all(F.regexp_replace("paragraph", r"`[^`]*`", " "), F.lit(r"(?<![\w\]])\[(\d{1,2}(?:\s*,\s*\d{1,2})*)\]"), F.lit(1))
    numbers = F.flatten(F.transform(marks, lambda m: F.split(m, r"\s*,\s*")))
    return paragraphs(answers).select("answer_id", "para", "paragraph", F.explode(F.array_distinct(F.transform(numbers, lambda n: n.cast("int")))).alias("n"))


def claim_terms(text: Column) -> Column:
    """Distinct words of more than three characters that carry meaning."""
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace(text, r"`[^`]*`", " ")), "[^a-z0-9]+", " "), " ")
    stop = F.array(*[F.lit(w) for w in CLAIM_STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~F.array_contains(stop, w)))


def evidence_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_]{3,})"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in EVIDENCE_STOPWORDS])
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w)))


def verify_citations(answers: DataFrame, citations: DataFrame, chunks: DataFrame, bar: float = 0.22) -> DataFrame:
    """A3: per paragraph and mark the share of the claim's terms that the cited chunk has.

    ``status`` is out of range, weak or ok; claims of fewer than five terms are not judged.
    """
    marks = citation_marks(answers).withColumn("claim", claim_terms(F.regexp_replace("paragraph", r"\[[\d,\s]+\]", " "))).where(F.size("claim") >= 5)
    named = chunks.join(citations.select("chunk_id").distinct(), "chunk_id", "left_semi")  # terms of cited chunks only
    cited = citations.join(named.select("chunk_id", claim_terms(F.col("text")).alias("source")), "chunk_id", "left")
    joined = marks.join(cited.select("answer_id", "n", F.lit(True).alias("known"), "source"), ["answer_id", "n"], "left")
    overlap = F.size(F.array_intersect("claim", "source")) / F.size("claim")
    status = F.when(F.col("known").isNull(), "out of range").when(F.col("source").isNull(), "no text").when(overlap < bar, "weak").otherwise("ok")
    return joined.select("answer_id", "para", "n", F.when(F.col("source").isNotNull(), F.round(overlap, 6)).alias("overlap"), status.alias("status"))


def citation_verdicts(verified: DataFrame) -> DataFrame:
    """A3: per answer how many marks were checked, and whether all hold."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return verified.groupBy("answer_id").agg((n("ok") + n("weak")).alias("checked"), n("weak").alias("weak"), n("out of range").alias("out_of_range")).withColumn(
        "ok", (F.col("weak") == 0) & (F.col("out_of_range") == 0)
    )


def weak_marks(answers: DataFrame, citations: DataFrame, chunks: DataFrame, most: int = 4, bar: float = 0.22) -> DataFrame:
    """A3: the first ``most`` weak citations of an answer (answer_id, place, para, n, overlap, claim), overlap to two digits."""
    weak = verify_citations(answers, citations, chunks, bar).where("status = 'weak'")
    order = Window.partitionBy("answer_id").orderBy("para", "n")
    first = weak.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    joined = first.join(paragraphs(answers), ["answer_id", "para"])
    return joined.select("answer_id", "place", "para", "n", F.round("overlap", 2).alias("overlap"), F.substring("paragraph", 1, 140).alias("claim"))


def passages(chunks: DataFrame, width: int = 900, stride: int = 650) -> DataFrame:
    """A4: windows of the paragraphs of a chunk, in order."""
    paras = chunks.select("chunk_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("p", "paragraph"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("paragraph") - 1, F.lit(0)), F.lit(stride))
    windows = paras.select("chunk_id", "p", "paragraph", F.explode(starts).alias("start"))
    cut = windows.withColumn("passage", F.trim(F.substring(F.col("paragraph"), F.col("start") + 1, F.lit(width)))).where("passage <> ''")
    return cut.select("chunk_id", "p", "start", "passage")


def evidence(answers: DataFrame, citations: DataFrame, chunks: DataFrame, bar: float = 0.22, most: int | None = 12) -> DataFrame:
    """A4: for each mark of the first ``most`` cited paragraphs the passage of the cited chunk with most of the claim's words, the earliest on ties.

    ``most`` is the length of the list that an answer shows; None takes all cited paragraphs.  ``citations`` has can_excerpt; sources without excerpts are restricted, unknown numbers missing.
    """
    claim = F.substring(F.trim(F.regexp_replace("paragraph", r"(?<![\w\]])\[\d+(?:\s*,\s*\d+)*\]", "")), 1, 1500)
    marks = citation_marks(answers)
    if most is not None:
        nth = F.dense_rank().over(Window.partitionBy("answer_id").orderBy("para"))
        marks = marks.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")
    marks = marks.withColumn("words", evidence_words(claim))
    joined = marks.join(citations.select("answer_id", "n", "chunk_id", "can_excerpt"), ["answer_id", "n"], "left")
    offered = passages(chunks.join(citations.where("can_excerpt").select("chunk_id").distinct(), "chunk_id", "left_semi")).withColumn("source", evidence_words(F.col("passage")))
    scored = joined.where("can_excerpt").join(offered, "chunk_id").withColumn(
        "score", F.when(F.size("words") > 0, F.size(F.array_intersect("words", "source")) / F.size("words")).otherwise(0.0)
    )
    best = scored.groupBy("answer_id", "para", "n").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("p")).alias("p"), (-F.col("start")).alias("s"), "passage")).alias("b"))
    status = (
        F.when(F.col("chunk_id").isNull(), "missing").when(~F.col("can_excerpt") | F.col("b").isNull(), "restricted")
        .when(F.col("b.score") >= bar, "matched").otherwise("weak")
    )
    return joined.join(best, ["answer_id", "para", "n"], "left").select(
        "answer_id", "para", "n", status.alias("status"), F.round("b.score", 6).alias("score"), F.substring("b.passage", 1, 900).alias("passage")
    )


def excerpt_policy(citations: DataFrame) -> DataFrame:
    """A1: what of a cited chunk may be shown and what may be read: all, a summary, or its title."""
    return citations.withColumn("excerpt", F.when(F.col("mode") == "full", F.col("text"))).withColumn(
        "prompt_body", F.when(F.col("mode").isin("full", "summarize"), F.col("text")).otherwise(F.col("page_title"))
    )


def unknown_symbols(answers: DataFrame, known: DataFrame) -> DataFrame:
    """A5: (answer_id, name) of type and method names in fenced code that no symbol table has.

    Comments, strings and import lines don't count, and names that the code itself declares are known.
    """
    code = F.array_join(F.regexp_extract_all("answer_md", F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1)), "\n")
    bare = F.regexp_replace(code, r'(?s)/\*.*?\*/|//[^\n]*|"[^"\n]*"|(?m)^\s*(?:package|import)[^\n]*$', " ")
    rows = answers.select("answer_id", bare.alias("code")).where("code <> ''")
    names = lambda p: F.array_distinct(F.regexp_extract_all("code", F.lit(p), F.lit(1)))
    used = rows.select("answer_id", F.explode(F.array_union(names(r"(?<![A-Za-z0-9_])([A-Z][A-Za-z0-9]+)(?![A-Za-z0-9_])"), names(r"\.([a-z][A-Za-z0-9]*)\s*\("))).alias("name"))
    local = rows.select("answer_id", F.explode(names(r"(?:class|interface|enum|void|int|double|boolean|String|[A-Z]\w*)\s+([A-Za-z_]\w*)\s*[({=;]")).alias("name"))
    return used.join(local, ["answer_id", "name"], "left_anti").join(known.select("name"), "name", "left_anti").select("answer_id", "name")


# The marks before the two halves of an answer, in the spellings that answers have, and the length of an opener.
GROUNDED_MARK = r"={2,}GROUNDED\+?={2,}"
BEYOND_MARK = r"={2,}BEYOND={2,}"
OPENER_LENGTH = 400


def split_beyond(text: Column) -> tuple[Column, Column]:
    """The grounded half and what follows the mark of the other half, empty where there is none.

    A grounded mark at the start goes with one line end after it, later ones go alone.  The grounded half's
    opener is dropped by A7's rule if it is at most 400 characters long.
    """
    lead = F.regexp_replace(text, r"^\s+", "")
    mark = F.regexp_extract(lead, f"^{GROUNDED_MARK}", 0)
    body = F.when(mark != "", F.regexp_replace(F.substring(lead, F.length(mark) + 1, F.length(lead)), r"^\r?\n", "")).otherwise(text)
    parts = F.split(body, BEYOND_MARK, 2)
    grounded = F.regexp_replace(F.element_at(parts, 1), GROUNDED_MARK, "")
    more = F.size(parts) > 1
    return drop_deflection(grounded, more, OPENER_LENGTH), F.when(more, F.element_at(parts, -1)).otherwise("")


# An opener that only says what the documentation lacks, and words by which a sentence turns.
DEFLECTION = (
    r"^[\s*_#>-]*(the\s+|this\s+|while\s+the\s+|although\s+the\s+)?(provided\s+|indexed\s+|available\s+|retrieved\s+|supplied\s+)?"
    r"(documentation|docs|sections?|index|corpus)\b[^.!?]{0,220}?\b(does\s+not|do\s+not|doesn't|don't|lacks?|contains?\s+no|is\s+silent|says?\s+nothing)\b"
)
CONTRAST = r"\b(but|however|though|whereas)\b"
MARK = r"\[\d{1,2}(?:\s*,\s*\d{1,2})*\]"


def drop_deflection(text: Column, more_follows: Column | None = None, longest: int | None = None) -> Column:
    """A first sentence that only says what the documentation lacks goes, if it turns nothing and something is left.

    ``more_follows`` says that the rest of the answer stands elsewhere, past the mark of its other half; sentences
    of more than ``longest`` characters stay.
    """
    pattern = r"(?s)^(\s*[^.!?]*[.!?])(.*)$"
    first, rest = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    left = (strip(rest) != "") | (F.lit(False) if more_follows is None else more_follows)
    deflects = strip(first).rlike(f"(?i){DEFLECTION}") & ~first.rlike(f"(?i){CONTRAST}")
    if longest is not None:
        deflects = deflects & (F.length(first) <= longest)
    return F.when((first != "") & left & deflects, F.regexp_replace(rest, r"^\s+", "")).otherwise(text)


def strip_marks(text: Column) -> Column:
    """Citation numbers go, except in fenced and inline code, after a word and after a closing bracket."""
    parts = F.split(text, r"(?m)^(?=\s*```)")  # every part but the first begins with a fence's line; odd ones are code
    prose = lambda p: F.regexp_replace(p, rf"(?m)(`[^`\n]*`)(?:{MARK})?|(^|[^\w\]`]){MARK}", "$1$2")
    fence = lambda p: F.regexp_extract(p, r"^[^\n]*\n?", 0)

    def part(p: Column, i: Column) -> Column:
        after = F.concat(fence(p), prose(F.substring(p, F.length(fence(p)) + 1, F.length(p))))
        return F.when(i == 0, prose(p)).when(i % 2 == 1, p).otherwise(after)

    return F.array_join(F.transform(parts, part), "")


def degraded_listing(cited: DataFrame, width: int = 700) -> DataFrame:
    """A numbered list of excerpts in place of an answer; cut texts end in an ellipsis with their fence closed."""
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.col("text"))
    fences = F.size(F.split(cut, "```")) - 1
    closed = F.when(fences % 2 == 1, F.concat(cut, F.lit("\n```"))).otherwise(cut)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "page_title", F.lit("\n"), F.when(F.col("mode") == "full", closed).otherwise("(not reproduced)"))
    lines = cited.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"), F.bool_or(F.col("mode") != "full").alias("restricted")
    )
    return lines.select("answer_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("listing"), "restricted")


def answer_disposition(answers: DataFrame) -> DataFrame:
    """A10: empty or persistable; needs grounded, beyond, is_public, covered and citation_count."""
    empty = (F.length(F.trim("grounded")) < 40) & (F.trim("beyond") == "")
    return answers.withColumn("empty", empty).withColumn(
        "persistable", ~empty & (F.trim("grounded") != "") & F.col("is_public") & F.col("covered") & (F.col("citation_count") > 0)
    )


# Which questions are about rules, and the notice that goes with their sources.
RULE_QUESTION = r"rule|legal|allowed|inspection|size|scor|season|biobuzz|\b[rgc]\d{3}\b"


def rules_notice(cited: DataFrame, questions: DataFrame, manual: str, manual_sources: list[str], answer_sources: list[str], indexed: str) -> DataFrame:
    """(answer_id, notice): answers that cite the official questions and answers, or the manual on a question about rules, say how old these are.

    ``manual`` names the manual's version, ``indexed`` the day of the snapshot; other answers get an empty notice.
    """
    flags = cited.groupBy("answer_id").agg(F.bool_or(F.col("source_id").isin(manual_sources)).alias("manual"), F.bool_or(F.col("source_id").isin(answer_sources)).alias("qa"))
    joined = flags.join(questions, "answer_id")
    coverage = F.array_join(F.array_compact(F.array(F.when(F.col("manual"), F.lit(manual)), F.when(F.col("qa"), F.lit(f"official Q&A snapshot {indexed}")))), " and ")
    text = F.concat(
        F.lit("Indexed rules snapshot: "), coverage,
        F.lit(f", indexed {indexed}. This may be out of date. Verify the current official manual and Team Q&A before relying on a rule interpretation."),
    )
    needed = F.col("qa") | (F.col("manual") & F.col("question").rlike(f"(?i){RULE_QUESTION}"))
    return joined.select("answer_id", F.when(needed, text).otherwise("").alias("notice"))


# What an observation says, and the next step it leads to (title, question, follow-ups), in order.
DIAGNOSTIC_RULES = [
    (1, r"name.*(does not match|doesn't match|mismatch)|different.*(configured|device).*name", "Compare the two names",
     "What exact name is in the robot configuration, and what exact string is passed to hardwareMap.get?",
     ["I corrected the name and the motor now moves.", "I corrected the name but the motor still does not move."]),
    (2, r"telemetry.*nonzero|(nonzero|non-zero).*power", "Check mode and mechanical load",
     "What run mode and target position are active, and does the mechanism move freely with power off?",
     ["The mechanism binds with power off.", "The mechanism moves freely; I will share the mode and target."]),
    (3, r"telemetry.*(zero|\b0\b).*power|(zero|\b0\b).*motor power", "Trace the control condition",
     "Which button or condition should set power, and does telemetry show that condition becoming true?",
     ["The control condition never becomes true.", "The condition is true but power is overwritten later."]),
    (4, r"configured name.*(matches|match exactly)|names match|name is correct", "Check the command being sent",
     "What power and run mode does telemetry show while you command the motor?", ["Telemetry shows zero motor power.", "Telemetry shows nonzero motor power."]),
    (5, r"does not move.*hardware test|doesn't move.*hardware test|hardware test.*(fails|does not move|doesn't move)", "Check power and connections",
     "With power off, are the device cable and hub connection seated, and does the hub show a power or connection fault?",
     ["I found a loose connection.", "The connections are seated and the hub has no fault."]),
    (6, r"hardware test.*(works|moves|passed)|(works|moves).*hardware test", "Compare configuration and code",
     "Does the configured device name match hardwareMap.get exactly, including capitalization?",
     ["The configured name matches exactly.", "I found a different configured device name."]),
    (7, r"unloaded|binds|binding|stalls.*(lift|attached|load)|(lift|load).*stalls", "Separate load from control",
     "With power off and the load supported, where does the mechanism bind, and what load and gear ratio are you using?",
     ["The mechanism binds with power off.", "It moves freely with power off; I will share the load and ratio."]),
]
MOVING = r"motor|servo|moves|moving"
FALLBACKS = {
    True: ("Separate hardware from code", "With the mechanism supported and the robot secured, does this device move in the hub hardware test?",
           ["It moves in the hardware test.", "It does not move in the hardware test."]),
    False: ("Narrow the failure", "When it fails, does the Control Hub restart, does the OpMode stop, or does only the mechanism stop?",
            ["The Control Hub restarts.", "The OpMode stays running; only the mechanism stops."]),
}
RULE_SCHEMA = "rule int, pattern string, title string, question string, follow_ups array<string>"


def diagnostic_steps(observations: DataFrame, rules: list[tuple] = DIAGNOSTIC_RULES) -> DataFrame:
    """The newest observation that any rule matches decides, by the first such rule; else one of two fallbacks.

    ``observations`` is (conv_id, age, text), age 0 the newest; curly apostrophes count as straight ones.
    """
    plain = F.regexp_replace("text", "[’‘]", "'")
    number = None
    for rule, pattern, *_ in rules:
        found = plain.rlike(f"(?i){pattern}")
        number = F.when(found, rule) if number is None else number.when(found, rule)
    picked = observations.select("conv_id", "age", number.alias("rule"), plain.rlike(f"(?i){MOVING}").alias("moving"))
    decided = picked.groupBy("conv_id").agg(F.min_by("rule", F.when(F.col("rule").isNotNull(), F.col("age"))).alias("rule"), F.bool_or("moving").alias("moving"))
    table = F.lit(None).cast("struct<title:string,question:string,follow_ups:array<string>>")
    made = lambda step: F.struct(F.lit(step[0]).alias("title"), F.lit(step[1]).alias("question"), F.array(*[F.lit(x) for x in step[2]]).alias("follow_ups"))
    for rule, _, *step in rules:
        table = F.when(F.col("rule") == rule, made(step)).otherwise(table)
    step = F.coalesce(table, F.when(F.col("moving"), made(FALLBACKS[True])).otherwise(made(FALLBACKS[False])))
    return decided.select("conv_id", "rule", step.alias("step")).select("conv_id", "rule", "step.*")


@dataclass(frozen=True)
class ContextLimits:
    """Bounds of a learning context, in characters but for the request's bytes."""

    body_bytes: int = 100_000
    question: int = 500
    files: int = 6
    code: int = 16_000
    error: int = 2_000
    attempt: int = 2_000
    lesson: int = 3_000
    name: str = r"^[\w .-]{1,100}$"
    modes: tuple[str, ...] = ("hint", "explain", "solution", "diagnose")


def context_rejections(contexts: DataFrame, limits: ContextLimits = ContextLimits()) -> DataFrame:
    """Adds the first ``reason`` why a learning context is refused, or null.

    Needs question, mode, files (an array of (name, source)), error, attempt and lesson; ``body_bytes`` where
    the request's size is known.
    """
    names = F.transform("files", lambda f: f["name"])
    size = F.aggregate("files", F.lit(0), lambda s, f: s + F.length(f["source"]))
    illegal = F.exists(names, lambda n: n.isNull() | ~n.rlike(limits.name)) | (F.size(F.array_distinct(names)) < F.size(names))
    fields = [F.length(c) > getattr(limits, c) for c in ("error", "attempt", "lesson") if c in contexts.columns]
    mode = ~F.col("mode").isin(*limits.modes) if "mode" in contexts.columns else F.lit(False)
    body = F.col("body_bytes") > limits.body_bytes if "body_bytes" in contexts.columns else F.lit(False)
    reason = (
        F.when(body, "request-too-large").when(F.length("question") > limits.question, "question-too-long").when(mode, "invalid-learning-mode")
        .when(F.size("files") > limits.files, "context-too-long").when(illegal, "invalid-code-file").when(size > limits.code, "context-too-long")
    )
    for field in fields:
        reason = reason.when(field, "context-too-long")
    return contexts.withColumn("reason", reason)


def sane_turns(turns: DataFrame, conversations: int = 30, most_turns: int = 200) -> DataFrame:
    """The newest conversations of each owner and the first turns of each that may be kept; turns without text go.

    ``turns`` is (owner, conv_id, turn, role, text), conversations being newer the larger their id.
    """
    order = Window.partitionBy("owner").orderBy(F.desc("conv_id"))
    kept = turns.select("owner", "conv_id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= conversations).drop("place")
    said = turns.where(F.col("role").isin("user", "assistant") & (strip(F.coalesce("text", F.lit(""))) != "")).join(kept, ["owner", "conv_id"], "left_semi")
    number = F.row_number().over(Window.partitionBy("owner", "conv_id").orderBy("turn"))
    return said.withColumn("_n", number).where(F.col("_n") <= most_turns).drop("_n")


def conversation_context(turns: DataFrame, width: int = 1200) -> DataFrame:
    """For each user turn the last two completed question-answer pairs before it, answers cut to a width.

    A pair carries the pair before it, so one row of state per turn is enough.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    asked = turns.withColumn("_asked", F.lag("text").over(order))
    answer = F.col("role") == "assistant"
    pair = F.when(answer, F.struct(F.col("turn"), F.col("_asked").alias("question"), F.substring("text", 1, width).alias("answer")))
    paired = asked.withColumn("_pair", pair).withColumn("_before", F.last("_pair", ignorenulls=True).over(earlier))
    both = paired.withColumn("_both", F.when(answer, F.array_compact(F.array("_before", "_pair"))))
    found = both.withColumn("_context", F.last("_both", ignorenulls=True).over(earlier)).where("role = 'user'")
    return found.select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("_context", F.array().cast(found.schema["_context"].dataType)).alias("context"))
