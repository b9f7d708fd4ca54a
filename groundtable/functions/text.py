"""Text analysis as column expressions: tokens, keys, classes and flags of questions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The words that carry no topic.
STOPWORDS = (
    "a an the and or but if then than that this these those "
    "is are was were be been being do does did doing have has had having "
    "i me my we our you your he she it its they them their "
    "what which who whom whose when where why how "
    "can could should would may might must will shall "
    "to of in on at by for with about against between into through during "
    "from up down out over under again further once here there all any both each "
    "few more most other some such no nor not only own same so too very s t just "
    "dont don't im i'm ive i've whats what's hows how's thats that's "
    "please help need want know tell explain use using used "
    "my robot team ftc"
).split()
# Stopwords that turn a question's meaning, kept in its cache key.
NEGATIONS = ["no", "nor", "not", "dont", "don't"]

# Words that mark a question as on topic by themselves, and words that need company.
STRONG_WORDS = [
    "ftc", "first tech", "mecanum", "odometry", "dead ?wheel", "opmode", "teleop", "hardwaremap", "control hub",
    "expansion hub", "driver station", "gobilda", "andymark", "road ?runner", "roadrunner", "pedro ?path", "ftclib",
    "apriltag", "limelight", "pinpoint", "swerve", "strafe", "linear slide", "game manual", "scrimmage", "pidf",
    "feedforward", "dcmotor", "servo", "encoder", "imu", "auton", "autonomous", "telemetry", "game ?piece",
    "game ?element", "motor", "drivetrain", "gear ?ratio", "sprocket", "turret", "outtake", "localiz", "trajectory",
    "kinematics", "robotics", "robot", "alliance", "ftc ?dashboard", "rev ?hub", "spark ?mini",
    "onshape", "solidworks", "fusion ?360", "part ?studio", "mate ?connector", "feature ?tree", "feature ?list",
    "fully ?defined", "parametric", "extrud", "chamfer", "counterbore", "countersink", "tap ?drill",
    "clearance hole", "mid-?plane", "datum", "stl", "step ?file",
]
WEAK_WORDS = [
    "wheel", "chassis", "gear", "belt", "chain", "bearing", "shaft", "torque", "rpm", "battery", "wiring", "sensor",
    "gyro", "vision", "camera", "intake", "claw", "arm", "lift", "linkage", "slide", "tune", "tuning", "pid", "sdk",
    "java", "code", "program", "build", "field", "match", "team", "competition", "inspection", "notebook", "judging",
    "award", "drive", "spline", "path", "pose", "heading", "tick", "ramp", "stall", "brownout", "auto", "preload",
    "park", "cycle", "score", "strafing", "gamepad",
    "cad", "sketch", "revolve", "sweep", "loft", "fillet", "shell", "draft", "rib", "hole", "pattern", "profile",
    "boolean", "union", "subtract", "intersect", "mirror", "transform", "move face", "direct edit", "imported",
    "import", "surface", "mesh", "thicken", "variable", "expression", "equation", "plane", "axis", "axes", "assembly",
    "mate", "model", "part", "constraint", "dimension", "wall thickness", "bolt circle", "angle", "bracket", "plate",
    "spacer", "standoff", "tolerance", "clearance", "corner", "edge", "face", "body", "geometry", "reference",
    "radius", "diameter", "thickness",
]
# Patterns of small talk and of questions about the service.
META_PATTERNS = [
    r"^\s*(hi|hey|hello|yo|sup|good (morning|afternoon|evening))\b",
    r"\bwhat (can|do|can't|cannot|don't) (you|it) (not )?(do|know|answer)\b",
    r"\bwhat (are|is) (your|its) (limits?|limitations?)\b",
    r"\b(what|anything) (you|it) (can't|cannot|won't) (do|answer|help)\b",
    r"\bwho (made|built|created) (you|this)\b",
    r"\bwhat (are|is) (you|this)( site| tool)?\b",
    r"\bhow (do|does) (you|this) work\b",
    r"\b(help|start|get started)\s*$",
    r"\bare you (an? )?(ai|bot|human)\b",
]
# Patterns by which a question's intent is told.
RULE_PATTERN = r"\b(rule|legal|allowed|permitted|manual|inspection|penalt)\w*\b"
DEBUG_PATTERNS = [
    r"\b(why (does|is|won'?t|isn'?t|do)|not working|doesn'?t work|keeps? (dropping|failing|stalling|resetting|slipping))\b",
    r"\b(browns? out|jitter|oscillat|overheat|stall|drift|skip|strip)\w*\b",
    r"\b(fix|troubleshoot|diagnose|debug)\b",
]
ADVICE_PATTERNS = [
    r"\b(should|would|recommend|suggest|advice|best|better|worth|prefer)\b",
    r"\bwhich (one|should|is better)\b",
    r"\bhow (do|would) (i|we|you) (choose|decide|pick)\b",
    r"\b(vs\.?|versus|or)\b.*\?",
    r"\bis it (ok|okay|fine|bad|good|worth)\b",
    r"\bwhat.*(ratio|size|gauge|material|motor|wheel).*(for|on)\b",
    r"\btradeoffs?\b",
]
LOOKUP_PATTERNS = [
    r"\bwhat (goes|belongs) (in|into|on)\b",
    r"\bwhat (does|is) (rule|r\d|g\d|i\d|a\d|e\d)\b",
    r"\b(rule|manual|legal|allowed|permitted|inspection)\b",
    r"\bwhat (is|are) (a|an|the)\b",
    r"\bwhere (is|can i find)\b",
]


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column) -> Column:
    """Lower-case runs of ``a-z0-9._-``; a dotted identifier gives itself and its longer parts."""
    raw = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9._-]+", " "), " ")
    clean = F.transform(raw, lambda t: F.regexp_replace(t, "^[._-]+|[._-]+$", ""))

    def parts(t: Column) -> Column:
        dotted = t.rlike(r"^[a-z0-9]+(\.[a-z0-9_]+)+$") & (F.length(t) > 6)
        return F.when(dotted, F.concat(F.array(t), F.filter(F.split(t, r"\."), lambda p: F.length(p) > 2))).otherwise(F.array(t))

    return F.filter(F.flatten(F.transform(clean, parts)), lambda t: (F.length(t) >= 2) & (F.length(t) <= 64))


def token_rows(rows: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """X1 as rows (kept columns, place, term): the way to tokenise a corpus, without nested arrays.

    ``place`` counts the runs of token characters, so an identifier and its parts share one.
    """
    runs = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("([a-z0-9._-]+)"), F.lit(1))
    raw = rows.select(*keep, F.posexplode(runs).alias("place", "_raw"))
    clean = raw.withColumn("_raw", F.regexp_replace("_raw", "^[._-]+|[._-]+$", ""))
    parts = F.regexp_replace(F.regexp_replace("_raw", r"\.", " "), r"(?<![^ ])[^ ]{1,2}(?![^ ])", "")
    dotted = F.col("_raw").rlike(r"^[a-z0-9]+(\.[a-z0-9_]+)+$") & (F.length("_raw") > 6)
    split = F.when(dotted, F.concat_ws(" ", F.col("_raw"), parts)).otherwise(F.col("_raw"))
    return clean.select(*keep, "place", F.explode(F.split(split, " +")).alias("term")).where(F.length("term").between(2, 64))


def content_terms(text: Column) -> Column:
    """Distinct tokens without stopwords, in order of first sight."""
    stop = _words(sorted(set(STOPWORDS)))
    return F.array_distinct(F.filter(tokenize(text), lambda t: ~F.array_contains(stop, t)))


def cache_terms(text: Column) -> Column:
    """As content terms, but negations stay."""
    stop = _words(sorted(set(STOPWORDS) - set(NEGATIONS)))
    return F.array_distinct(F.filter(tokenize(text), lambda t: ~F.array_contains(stop, t)))


def search_terms(text: Column, limit: int = 12) -> Column:
    """The first content terms, or the first tokens where there are none; null where there are none either."""
    terms, tokens = content_terms(text), tokenize(text)
    chosen = F.when(F.size(terms) > 0, F.slice(terms, 1, limit)).otherwise(F.slice(tokens, 1, limit))
    return F.when(F.size(chosen) > 0, chosen)


def term_coverage(terms: Column, haystack: Column) -> Column:
    """Share of terms, or of their stems, that occur in a text."""
    low = F.lower(haystack)

    def found(t: Column) -> Column:
        stem = F.when(F.length(t) > 6, F.substring(t, F.lit(1), F.length(t) - 2)).otherwise(t)
        return F.contains(low, t) | ((F.length(stem) >= 4) & F.contains(low, stem))

    hits = F.size(F.filter(terms, found))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


@F.arrow_udf(StringType())
def without_marks(texts: pa.Array) -> pa.Array:
    """Compatibility forms taken apart (NFKD) and combining marks dropped."""
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return pa.array([t if t is None or t.isascii() else plain(t) for t in texts.to_pylist()], pa.string())


def normalize_question(text: Column) -> Column:
    """Lower case, compatibility forms and marks dropped, everything else but letters and digits one space."""
    return F.trim(F.regexp_replace(without_marks(F.lower(text)), "[^a-z0-9]+", " "))


def question_slug(text: Column, digest: Column) -> Column:
    """At most ten words and 70 characters, and six characters of a hash."""
    base = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", "-")
    base = F.regexp_replace(base, "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(F.array_join(F.slice(F.split(base, "-"), 1, 10), "-"), 1, 70), "-+$", "")
    return F.concat_ws("-", F.when(cut == "", "question").otherwise(cut), F.substring(digest, 1, 6))


def cache_key(text: Column, epoch: Column) -> Column:
    """The epoch and a hash of the ordered cache terms, or of the normalised question where there are none."""
    terms = F.array_join(cache_terms(text), " ")
    return F.concat_ws(":", epoch, F.sha2(F.when(terms != "", terms).otherwise(normalize_question(text)), 256))


def legacy_key(text: Column, epoch: Column) -> Column:
    """The key under which older entries stand: the epoch and a hash of the normalised question."""
    return F.concat_ws(":", epoch, F.sha2(normalize_question(text), 256))


def any_match(text: Column, patterns: list[str]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def _any_word(vocabulary: list[str]) -> str:
    """A pattern of the words of a vocabulary, which begin after anything but ``a-z0-9_``; alternatives are told by their first letter."""
    first: dict[str, list[str]] = {}
    for word in vocabulary:
        first.setdefault(word[0], []).append(word[1:])
    return f"(?=[{''.join(first)}])(?<![a-z0-9_])(" + "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in first.items()) + ")"


def distinct_hits(text: Column, vocabulary: list[str]) -> Column:
    """How many different words of a vocabulary a text has."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_any_word(vocabulary)), F.lit(1))))


def topic_class(text: Column, cosine: Column) -> Column:
    """Meta, ftc (on topic) or off."""
    cos = F.coalesce(cosine, F.lit(0.0))
    strong, needed = F.lower(text).rlike(_any_word(STRONG_WORDS)), F.when(cos >= 0.25, 1).otherwise(2)
    on = (cos >= 0.62) | strong | (distinct_hits(text, WEAK_WORDS) >= needed)  # the dearest test last
    return F.when(any_match(text, META_PATTERNS), "meta").when(on, "ftc").otherwise("off")


def intent_class(text: Column) -> Column:
    """Lookup, debug or advice; questions on rules are lookups however they are put."""
    return (
        F.when(any_match(text, [RULE_PATTERN]), "lookup")
        .when(any_match(text, DEBUG_PATTERNS), "debug")
        .when(any_match(text, ADVICE_PATTERNS), "advice")
        .when(any_match(text, LOOKUP_PATTERNS), "lookup")
        .otherwise("advice")
    )


def team_number(text: Column) -> Column:
    """A number from 1 to 99999 next to a cue word."""
    digits = F.regexp_extract(text, r"(?i)\b(?:team|ftc)\s*#?\s*(\d{1,5})\b", 1)
    number = F.when(digits != "", digits.cast("int"))
    return F.when(number.between(1, 99999), number)


def url_version(url: Column) -> Column:
    """The version that a URL names."""
    found = F.regexp_extract(url, r"(?i)/(?:v|version/)(\d+(?:\.\d+){0,2})(?:/|$)", 1)
    return F.when(found != "", F.concat(F.lit("v"), found, F.lit(" (source URL)"))).otherwise("Version not specified by index")


def source_version(source_id: Column, source_name: Column, url: Column, declared: Column, sdk: str, manual: str) -> Column:
    """The version that a source declares, else that of the SDK or the manual for their sources, else the URL's."""
    return (
        F.when(F.trim(F.coalesce(declared, F.lit(""))) != "", declared).when(source_id.rlike("ftc-sdk"), F.lit(f"FTC SDK {sdk}"))
        .when(source_id.rlike("competition|game-manual|ftc-manual") | source_name.rlike("Competition Manual"), F.lit(f"2026–2027 manual {manual}"))
        .otherwise(url_version(url))
    )


def retrieval_query(question: Column, title: Column, section: Column) -> Column:
    """Short questions get the page's title and section in front."""
    words = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != ""))
    return F.when(words <= 8, F.concat_ws(" — ", title, section, question)).otherwise(question)


LEARNING_SYMBOLS = (
    r"\b(?:DcMotor\w*|Servo|hardwareMap|setPower|setDirection|runOpMode|OpMode|LinearOpMode|IMU|VisionPortal|Follower|Telemetry)\b"
)


def learning_query(question: Column, prior: Column, title: Column, error: Column, code: Column) -> Column:
    """X14, learning: the question, prior questions (an array) if it is short, the page's title, the error and the code's symbols."""
    words = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: w != ""))
    before = F.when(words <= 8, F.substring(F.array_join(prior, " "), 1, 400))
    symbols = F.slice(F.array_distinct(F.regexp_extract_all(code, F.lit(LEARNING_SYMBOLS), F.lit(0))), 1, 12)
    parts = F.concat(F.array(question, before, title, F.substring(error, 1, 240)), F.coalesce(symbols, F.array().cast("array<string>")))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " — ")


# What asks for code, compares, strings demands together, greets, or names a library without an index.
CODE_REQUESTS = [
    r"\bwrite (me )?(the |a |an )?(code|program|opmode|class|method)", r"\bgenerate (the |a |an )?(code|program|opmode|class)",
    r"\bgive me (the |a |an )?(code|program|opmode|sample|example code)", r"\bshow me (the |a |an )?code", r"\bcode (for|to)\b", r"\bsample code", r"\bexample code",
    r"\bhow (do|would) i (code|program|write)", r"\bimplement (a|an|the)\b", r"\bmake (a|an) opmode", r"\bopmode\b", r"\bsample (opmode|program|class)",
    r"\bexample (opmode|program)", r"\bshow me (a|an|the)? ?(official )?(sample|example)",
]
COMPARES = r"\b(vs\.?|versus|compare|trade-?offs?|which is better|pros and cons)\b"
SEVERAL = r"\b(and then|as well as|also)\b"
GREETING = r"^\s*(h(ello|i|ey|iya)|yo|sup|good\s+(morning|afternoon|evening)|greetings|what\s*''?s\s+up|howdy|test|ping)\b[\s!.?]*$".replace("''?", ".?")
UNINDEXED = r"\b(solvers\s*lib|meepmeep|next\s*ftc|rr\s*dashboard)\b"
REGULATORY = r"rule|legal|allowed|inspection|scor|season|biobuzz|starting|pre-?load|\b[rgcq]\d{1,3}\b"
# Libraries by their names, cues of their API, and how a version is asked for or named.
LIBRARIES = [(r"pedro(\s*pathing)?|com\.pedropathing", "Pedro Pathing"), (r"road\s*runner|roadrunner", "Road Runner"), (r"ftclib", "FTCLib")]
API_CUE = r"API|method|compile|error|followPath|Follower|upgrade|import|code"
FINDS_VERSION = r"where|how.*(find|check|locate)"
NAMED_VERSION = (
    r"(com\.pedropathing|com\.acmerobotics\.roadrunner|com\.arcrobotics\.ftclib):[\w.-]+:\d+(\.\d+)*"
    r"|(pedro(\s*pathing)?|road\s*runner|roadrunner|ftclib)\s*(version\s*|v)?\d|\b(version|v)\s*\d+(\.\d+)*"
)


def code_request(text: Column) -> Column:
    """X11: code is asked for."""
    return any_match(text, CODE_REQUESTS)


def needs_depth(text: Column, turns: Column, code: Column | None = None, error: Column | None = None) -> Column:
    """X11: code or an error is at hand, advice or a diagnosis is wanted, things are compared, several are asked, or the talk is long.

    ``turns`` is the number of earlier turns; ``code`` and ``error`` come with the request.
    """
    given = F.coalesce(code if code is not None else F.lit(False), F.lit(False)) | F.coalesce(error if error is not None else F.lit(False), F.lit(False))
    several = F.regexp_count(text, F.lit(r"\?")) > 1
    together = text.rlike(f"(?i){SEVERAL}") & (F.length(text) > 90)
    return given | intent_class(text).isin("advice", "debug") | text.rlike(f"(?i){COMPARES}") | several | together | (F.length(text) > 180) | (turns >= 4)


def is_greeting(text: Column) -> Column:
    """X11: nothing but a greeting."""
    return text.rlike(f"(?i){GREETING}")


def unindexed_library(text: Column) -> Column:
    """X11: a library is named that no source covers."""
    return text.rlike(f"(?i){UNINDEXED}")


def regulatory_question(text: Column, source_ids: Column, source_names: Column) -> Column:
    """X11: a question on rules among whose sources is the official manual or its questions and answers."""
    official = F.exists(source_ids, lambda s: s == "first-qa") | F.exists(source_names, lambda n: n.rlike("Competition Manual|Official Team Q&A"))
    return official & text.rlike(f"(?i){REGULATORY}")


def disposition() -> Column:
    """What becomes of a question, in fixed order.

    Reads valid, greeting, admitted, cached, unindexed_library, passed, topic and under_ceiling.
    """
    return (
        F.when(~F.col("valid"), "invalid").when(F.col("greeting"), "greeting").when(~F.col("admitted"), "rate-limited").when(F.col("cached"), "cached")
        .when(F.col("unindexed_library"), "unindexed library")
        .when(F.col("passed") & F.col("under_ceiling"), "grounded").when(F.col("passed"), "degraded")
        .when(F.col("topic") == "meta", "meta").when(F.col("topic") == "ftc", "uncovered").otherwise("off-topic")
    )


def missing_version(question: Column, context: Column | None = None, observations: Column | None = None) -> Column:
    """The library whose version has to be asked for; null where none is.

    A library and its API are talked about in the ``context`` (question, settings, earlier questions,
    attempts and code), the question is not where to find the version, and none of the ``observations``
    (the same without code) names one.
    """
    said = question if context is None else context
    seen = question if observations is None else observations
    library = None
    for pattern, name in LIBRARIES:
        found = said.rlike(f"(?i){pattern}")
        library = F.when(found, name) if library is None else library.when(found, name)
    finds = question.rlike(f"(?i){FINDS_VERSION}") & question.rlike("(?i)version")
    return F.when(said.rlike(f"(?i){API_CUE}") & ~finds & ~seen.rlike(f"(?i){NAMED_VERSION}"), library)
