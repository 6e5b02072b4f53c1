"""Dead code: symbols that nothing refers to, but for those that a framework or a user calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: decorators and paths that mark tests and code that a framework calls
TEST_DECORATORS = (
    r"(?i)^@pytest\.(fixture|mark|hookimpl)",
    r"(?i)^@(fixture|pytest_fixture)\b",
    r"(?i)^@unittest\.(skip|skipIf|skipUnless)",
)
TEST_PATHS = (r"(?i)(^|/)test_[^/]+\.py$", r"(?i)(^|/)[^/]+_test\.py$", r"(?i)(^|/)tests?(/|$)")
FRAMEWORK_DECORATORS = (
    r"(?i)^@(app|router|api_router|bp|blueprint|server|api)\.(get|post|put|delete|patch|options|head|route|websocket|api_route|on_event|middleware|exception_handler)\b",
    r"(?i)^@(app|router|api_router|bp|blueprint)\.",
    r"(?i)^@(click|typer|app|cli|main)\.(command|group|callback|argument|option)\b",
    r"(?i)^@click\.",
    r"(?i)^@typer\.",
    r"(?i)^@(shared_task|task|job|actor)\b",
    r"(?i)^@(app|celery)\.task\b",
    r"(?i)^@(receiver|admin\.register)\b",
    r"(?i)^@(listener|consumer|event_handler|subscriber)\b",
    r"(?i)^@(abstractmethod|abc\.abstractmethod|override|overload)\b",
    r"(?i)^@(validator|field_validator|model_validator|root_validator)\b",
)
MAIN_NAMES = ("main", "cli", "run")


def is_export() -> Column:
    return F.coalesce(F.col("is_exported"), F.lit(False)) | F.col("file_path").rlike(r"(^|/)__init__\.py$")


def any_like(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def is_test() -> Column:
    name = F.col("name")
    named = name.startswith("test_") | name.endswith("_test") | ((F.col("kind") == "class") & (name.startswith("Test") | name.endswith("Test") | name.endswith("TestCase")))
    return named | F.exists("decorators", lambda d: any_like(d, TEST_DECORATORS)) | any_like(F.col("file_path"), TEST_PATHS)


def is_framework_entry() -> Column:
    return F.exists("decorators", lambda d: any_like(d, FRAMEWORK_DECORATORS))


def is_magic() -> Column:
    return F.col("name").rlike(r"^__[a-zA-Z0-9_]+__$")


def is_main() -> Column:
    return F.col("kind").isin("function", "async_function") & F.col("name").isin(*MAIN_NAMES)


RULES = (("export", is_export), ("test", is_test), ("framework", is_framework_entry), ("magic", is_magic), ("main", is_main))


def whitelist_reason(custom: Column | None = None) -> Column:
    """The first rule that exempts a symbol, or null."""
    reason = F.lit(None).cast("string") if custom is None else F.when(custom, F.lit("custom"))
    for name, rule in reversed(RULES):
        reason = F.when(F.coalesce(rule(), F.lit(False)), F.lit(name)).otherwise(reason)
    return reason


def detect(nodes: DataFrame, edges: DataFrame, used: DataFrame | None = None, ignore_contains: bool = True, include_methods: bool = True, custom: Column | None = None) -> DataFrame:
    """(node_id, name, kind, effective_in_degree, reason) of dead symbols.

    ``nodes`` need id, name, kind, file_path, decorators, is_exported; ``used(target_id)`` names
    symbols with a usage outside the graph. Exempt symbols go first, so the anti-joins see
    candidates only; edges reach the join as distinct targets, so a hub counts once.
    """
    candidates = nodes.where(whitelist_reason(custom).isNull())
    if not include_methods:
        candidates = candidates.where(~F.col("kind").isin("method", "class_method", "static_method"))
    counted = edges.where("kind <> 'contains'") if ignore_contains else edges
    targets = counted.select(F.col("target").alias("__t")).distinct()
    dead = candidates.join(targets, F.col("id") == F.col("__t"), "left_anti")
    if used is not None:
        dead = dead.join(used.select(F.col("target_id").alias("__u")).distinct(), F.col("id") == F.col("__u"), "left_anti")
    reason = F.concat(F.lit("no incoming reference to "), "kind", F.lit(" "), "name")
    return dead.select(F.col("id").alias("node_id"), "name", "kind", F.lit(0).cast("long").alias("effective_in_degree"), reason.alias("reason"))


def simple_dead(nodes: DataFrame, edges: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The resolver's own rule: no call, creation or inheritance points at it, no usage, no dunder name."""
    named = nodes.where(~is_magic())
    targets = edges.where(F.col("kind").isin("calls", "instantiates", "inherits")).select(F.col("target").alias("__t")).distinct()
    dead = named.join(targets, F.col("id") == F.col("__t"), "left_anti")
    if used is not None:
        dead = dead.join(used.select(F.col("target_id").alias("__u")).distinct(), F.col("id") == F.col("__u"), "left_anti")
    return dead.select("id", "name", "kind")


def mark(nodes: DataFrame, dead: DataFrame) -> DataFrame:
    """``nodes`` with is_dead."""
    flags = dead.select(F.col("node_id").alias("__d")).distinct()
    return nodes.join(flags, F.col("id") == F.col("__d"), "left").withColumn("is_dead", F.col("__d").isNotNull()).drop("__d")
