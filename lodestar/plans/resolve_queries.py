"""Name resolution over synthetic imports and calls made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import resolve as R
from lodestar.plans.canonical import CTE
from lodestar.plans.registry import query
from lodestar.sources.stages import exchanged, stage
from lodestar.sources.tables import register

#: Classes keep their names; methods share 23 names and functions about 700, so that rules by uniqueness, file and class all have work.
INPUTS = CTE + """,
rsym AS (SELECT id, CASE WHEN kind = 'class' THEN name WHEN parent_class_id IS NOT NULL THEN 'm' || (pk % 23) ELSE 'fn' || (pk % 701) END AS name, kind, file_path, parent_class_id, sym_ord % 3 <> 0 AND parent_class_id IS NULL AS is_exported, sym_ord, pk, sk FROM symbols),
rfiles AS (SELECT file_path, row_number() OVER (ORDER BY file_path) AS file_ord FROM (SELECT DISTINCT file_path FROM symbols)),
nf AS (SELECT count(*) AS n FROM rfiles),
pairs AS (SELECT s.file_path, s.pk, t.file_path AS tfile, y.name AS tname, y.kind AS tkind FROM rsym s CROSS JOIN nf JOIN rfiles t ON t.file_ord = (s.pk * 7 + 3) % nf.n + 1 JOIN (SELECT file_path, min(name) AS name, min(kind) AS kind FROM rsym WHERE parent_class_id IS NULL GROUP BY file_path) y ON y.file_path = t.file_path WHERE s.pk >= 0),
rimp AS (SELECT file_path,
    CASE pk % 6 WHEN 0 THEN replace(regexp_replace(tfile, '[.]py$', ''), '/', '.') WHEN 1 THEN replace(regexp_replace(regexp_replace(tfile, '[.]py$', ''), '^[^/]*/', ''), '/', '.')
      WHEN 2 THEN regexp_replace(regexp_replace(tfile, '[.]py$', ''), '^.*/', '') WHEN 3 THEN replace(regexp_replace(tfile, '/[^/]*$', ''), '/', '.') WHEN 4 THEN replace(regexp_replace(regexp_replace(tfile, '[.]py$', ''), '^[^/]*/', ''), '/', '.') ELSE replace(regexp_replace(tfile, '[.]py$', ''), '/', '.') END AS module_name,
    CASE pk % 6 WHEN 0 THEN tname WHEN 1 THEN tname WHEN 2 THEN tname WHEN 3 THEN regexp_replace(regexp_replace(tfile, '[.]py$', ''), '^.*/', '') END AS imported_symbol,
    CASE WHEN pk % 6 = 4 THEN 'mod' || (pk % 5) WHEN pk % 12 = 0 THEN 'al' || (pk % 7) END AS alias, pk % 6 = 5 AS is_wildcard,
    CASE WHEN pk % 6 = 2 THEN 1 + (pk // 6) % 2 ELSE 0 END AS level, pk AS imp_ord FROM pairs),
rcall AS (SELECT pk AS call_ord, file_path, id AS caller_id, parent_class_id,
    CASE pk % 9 WHEN 0 THEN 'self.m' || (pk // 9 % 23) WHEN 1 THEN 'super().m' || (pk // 9 % 23) WHEN 2 THEN 'mod' || (pk % 5) || '.fn' || (pk % 701) WHEN 3 THEN 'arg.m' || (pk // 9 % 23)
      WHEN 4 THEN 'x.m' || (pk // 9 % 23) WHEN 5 THEN 'S' || (pk % 50) WHEN 6 THEN 'fn' || (pk * 3 % 701) WHEN 7 THEN 'al' || (pk % 7) ELSE 'q.fn' || (pk * 5 % 701) END AS callee_name, pk * 10 AS line, CAST(5 AS bigint) AS col FROM rsym WHERE pk >= 0
  UNION ALL SELECT 1000000000 + pk, file_path, id, parent_class_id, 'S' || (pk // 2 % 50), pk * 10 + 1, CAST(5 AS bigint) FROM rsym WHERE pk % 9 IN (3, 4)),
rbase AS (SELECT id AS class_id, CAST(0 AS int) AS base_ord, 'S' || CAST(floor(sk / 2) AS bigint) AS base FROM rsym WHERE sk > 0),
rpar AS (SELECT id, 'arg' AS param, 'S' || (pk % 40) AS type_hint FROM rsym WHERE pk >= 0 AND pk % 2 = 1)
"""


class Inputs:
    """The resolver's six input tables as stage tables, and what several rules share, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        register(spark, sf_dir)
        self.spark, self.text, self.made = spark, INPUTS.replace("//", "div"), {}

    def once(self, name: str, make) -> DataFrame:  # noqa: ANN001
        if name not in self.made:
            with exchanged(self.spark):
                self.made[name] = stage(make(), f"resolver-{name}")
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.once(name, lambda: self.spark.sql(f"{self.text} SELECT * FROM {name}"))

    files = property(lambda self: self.table("rfiles"))
    symbols = property(lambda self: self.table("rsym"))
    imports = property(lambda self: self.table("rimp"))
    bases = property(lambda self: self.table("rbase"))
    params = property(lambda self: self.table("rpar"))
    calls = property(lambda self: self.table("rcall").drop("parent_class_id"))

    def resolved(self) -> DataFrame:
        return self.once("resolved", lambda: R.resolve_imports(self.imports, self.files))

    def scope(self) -> DataFrame:
        return self.once("scope", lambda: R.scopes(self.imports, self.files, self.symbols))

    def links(self) -> DataFrame:
        return self.once("links", lambda: R.base_links(self.bases, self.symbols, self.scope()))

    def closure(self) -> DataFrame:
        return self.once("closure", lambda: R.ancestors(self.links()))

    def methods(self) -> DataFrame:
        return self.once("methods", lambda: R.method_table(self.symbols, self.closure()))

    def split(self) -> DataFrame:
        return R.split_calls(self.calls, self.symbols)


SQL = INPUTS.replace("WITH cls", "WITH RECURSIVE cls", 1) + """,
rel AS (SELECT i.imp_ord, min({'c': c.k, 'p': f.file_path}) AS m FROM (
    SELECT imp_ord, imported_symbol, CASE WHEN f = '' THEN m ELSE f || '/' || m END AS base FROM (SELECT *, array_to_string(string_split(file_path, '/')[:greatest(len(string_split(file_path, '/')) - level, 0)], '/') AS f, replace(module_name, '.', '/') AS m FROM rimp WHERE level > 0)) i
  CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k) c JOIN rfiles f ON f.file_path = CASE c.k WHEN 0 THEN i.base || '.py' WHEN 1 THEN i.base || '/__init__.py' WHEN 2 THEN i.base ELSE i.base || '/' || i.imported_symbol || '.py' END GROUP BY i.imp_ord),
exa AS (SELECT imp_ord, f.file_path AS path FROM rimp JOIN rfiles f ON f.file_path = replace(module_name, '.', '/') || '.py'),
suf AS (SELECT imp_ord, arg_min(f.file_path, f.file_ord) AS path FROM rimp JOIN rfiles f ON f.file_path = replace(module_name, '.', '/') || '.py' OR ends_with(f.file_path, '/' || replace(module_name, '.', '/') || '.py') GROUP BY imp_ord),
sub AS (SELECT imp_ord, arg_min(f.file_path, f.file_ord) AS path FROM rimp JOIN rfiles f ON f.file_path = replace(module_name, '.', '/') || '/' || imported_symbol || '.py' OR ends_with(f.file_path, '/' || replace(module_name, '.', '/') || '/' || imported_symbol || '.py') GROUP BY imp_ord),
res AS (SELECT imp_ord, arg_min(path, w) AS path FROM (SELECT imp_ord, m.p AS path, 0 AS w FROM rel UNION ALL SELECT imp_ord, path, 1 FROM exa UNION ALL SELECT imp_ord, path, 2 FROM suf UNION ALL SELECT imp_ord, path, 3 FROM sub) GROUP BY imp_ord),
sloc AS (SELECT file_path, name, 'symbol' AS kind, arg_max(id, sym_ord) AS target_id, NULL::VARCHAR AS target_file, max(sym_ord) AS ord FROM rsym WHERE kind = 'class' GROUP BY file_path, name),
swil AS (SELECT i.file_path, s.name, 'symbol' AS kind, min({'a': i.imp_ord, 'b': s.sym_ord, 'id': s.id}).id AS target_id, NULL::VARCHAR AS target_file, min(i.imp_ord) AS ord FROM rimp i JOIN res USING (imp_ord) JOIN rsym s ON s.file_path = res.path WHERE i.is_wildcard AND s.is_exported GROUP BY i.file_path, s.name),
fst AS (SELECT file_path, name, arg_min(id, sym_ord) AS id FROM rsym GROUP BY file_path, name),
sfro AS (SELECT file_path, name, max({'o': imp_ord, 'k': CASE WHEN id IS NOT NULL THEN 'symbol' ELSE 'module' END, 't': id, 'f': CASE WHEN id IS NULL THEN path END}) AS m FROM (
    SELECT i.file_path, coalesce(i.alias, i.imported_symbol) AS name, i.imp_ord, fst.id, res.path FROM rimp i JOIN res USING (imp_ord) LEFT JOIN fst ON fst.file_path = res.path AND fst.name = i.imported_symbol WHERE i.imported_symbol IS NOT NULL AND NOT i.is_wildcard AND (fst.id IS NOT NULL OR ends_with(res.path, '/' || i.imported_symbol || '.py') OR res.path = i.imported_symbol || '.py')) GROUP BY file_path, name),
smod AS (SELECT i.file_path, coalesce(i.alias, string_split(i.module_name, '.')[-1]) AS name, arg_max(res.path, i.imp_ord) AS target_file, max(i.imp_ord) AS ord FROM rimp i JOIN res USING (imp_ord) WHERE i.imported_symbol IS NULL AND NOT i.is_wildcard GROUP BY 1, 2),
sall AS (SELECT *, 0 AS layer, 1 AS late FROM swil UNION ALL SELECT *, 1, 0 FROM sloc UNION ALL SELECT file_path, name, 'module', NULL, target_file, ord, 2, 1 FROM smod UNION ALL SELECT file_path, name, m.k, m.t, m.f, m.o, 2, 1 FROM sfro),
scope AS (SELECT file_path, name, max({'l': layer, 'o': ord, 'k': kind, 't': target_id, 'f': target_file}) AS m, min({'l': late, 'o': ord}) AS ord FROM sall GROUP BY file_path, name),
rcls AS (SELECT * FROM rsym WHERE kind = 'class'),
uni AS (SELECT name, min(id) AS id FROM rsym GROUP BY name HAVING count(*) = 1),
ucl AS (SELECT name, min(id) AS id FROM rcls GROUP BY name HAVING count(*) = 1),
lnk AS (SELECT c.id AS class_id, coalesce(s.m.t, sl.target_id, u.id) AS parent_id FROM rbase b JOIN rcls c ON c.id = b.class_id LEFT JOIN scope s ON s.file_path = c.file_path AND s.name = b.base AND s.m.k = 'symbol' AND s.m.t IN (SELECT id FROM rcls) LEFT JOIN sloc sl ON sl.file_path = c.file_path AND sl.name = b.base LEFT JOIN ucl u ON u.name = b.base WHERE coalesce(s.m.t, sl.target_id, u.id) IS NOT NULL),
anc(class_id, ancestor_id, depth) AS (SELECT class_id, parent_id, 1 FROM lnk WHERE class_id <> parent_id UNION ALL SELECT a.class_id, l.parent_id, a.depth + 1 FROM anc a JOIN lnk l ON l.class_id = a.ancestor_id WHERE a.depth < 32 AND l.class_id <> l.parent_id AND l.parent_id <> a.class_id),
meth AS (SELECT class_id, name, arg_min(id, {'d': depth, 's': sym_ord}) AS id FROM (SELECT parent_class_id AS class_id, name, id, 0 AS depth, sym_ord FROM rsym WHERE parent_class_id IS NOT NULL UNION ALL SELECT a.class_id, s.name, s.id, a.depth, s.sym_ord FROM anc a JOIN rsym s ON s.parent_class_id = a.ancestor_id) GROUP BY class_id, name),
cal AS (SELECT *, CASE WHEN starts_with(callee_name, 'super().') AND parent_class_id IS NOT NULL THEN 'super' WHEN contains(callee_name, '.') THEN 'dotted' ELSE 'bare' END AS branch, string_split(callee_name, '.')[1] AS receiver, regexp_replace(callee_name, '^[^.]*[.]?', '') AS method FROM rcall),
r_super AS (SELECT call_ord, arg_min(m.id, a.depth) AS target_id FROM cal c JOIN anc a ON a.class_id = c.parent_class_id JOIN meth m ON m.class_id = a.ancestor_id AND m.name = c.method WHERE branch = 'super' GROUP BY call_ord),
r_self AS (SELECT call_ord, m.id AS target_id FROM cal c JOIN meth m ON m.class_id = c.parent_class_id AND m.name = c.method WHERE branch = 'dotted' AND receiver IN ('self', 'cls')),
r_module AS (SELECT call_ord, f.id AS target_id FROM cal c JOIN scope s ON s.file_path = c.file_path AND s.name = c.receiver AND s.m.k = 'module' JOIN fst f ON f.file_path = s.m.f AND f.name = c.method WHERE branch = 'dotted'),
hint AS (SELECT call_ord, method, coalesce(s.m.t, u.id) AS class_id FROM cal c JOIN rpar p ON p.id = c.caller_id AND p.param = c.receiver LEFT JOIN scope s ON s.file_path = c.file_path AND s.name = p.type_hint AND s.m.k = 'symbol' AND s.m.t IN (SELECT id FROM rcls) LEFT JOIN ucl u ON u.name = p.type_hint WHERE branch = 'dotted' AND coalesce(s.m.t, u.id) IS NOT NULL),
r_param AS (SELECT call_ord, m.id AS target_id FROM hint h JOIN meth m ON m.class_id = h.class_id AND m.name = h.method),
made AS (SELECT c.caller_id, s.m.t AS class_id, c.call_ord AS ord FROM cal c JOIN scope s ON s.file_path = c.file_path AND s.name = c.callee_name AND s.m.k = 'symbol' WHERE s.m.t IN (SELECT id FROM rcls)),
r_instance AS (SELECT c.call_ord, arg_min(m.id, {'a': CASE WHEN contains(lower(c.receiver), lower(k.name)) OR contains(lower(k.name), lower(c.receiver)) THEN 0 ELSE 1 END, 'o': d.ord}) AS target_id FROM cal c JOIN made d ON d.caller_id = c.caller_id JOIN rcls k ON k.id = d.class_id JOIN meth m ON m.class_id = d.class_id AND m.name = c.method WHERE branch = 'dotted' AND c.call_ord NOT IN (SELECT call_ord FROM hint) GROUP BY c.call_ord),
r_scope AS (SELECT c.call_ord, arg_min(m.id, {'o': s.ord, 'c': s.m.t}) AS target_id FROM cal c JOIN scope s ON s.file_path = c.file_path AND s.m.k = 'symbol' JOIN rcls k ON k.id = s.m.t JOIN meth m ON m.class_id = s.m.t AND m.name = c.method WHERE branch = 'dotted' GROUP BY c.call_ord),
r_unique AS (SELECT call_ord, u.id AS target_id FROM cal c JOIN uni u ON u.name = c.method WHERE branch = 'dotted'),
r_bare AS (SELECT call_ord, s.m.t AS target_id FROM cal c JOIN scope s ON s.file_path = c.file_path AND s.name = c.callee_name AND s.m.k = 'symbol' WHERE branch = 'bare'),
r_same AS (SELECT call_ord, l.id AS target_id FROM cal c JOIN (SELECT file_path, name, arg_max(id, sym_ord) AS id FROM rsym GROUP BY file_path, name) l ON l.file_path = c.file_path AND l.name = c.callee_name WHERE branch = 'bare'),
ufn AS (SELECT name, min(id) AS id FROM rsym WHERE kind <> 'class' GROUP BY name HAVING count(*) = 1),
r_name AS (SELECT call_ord, arg_min(id, w) AS target_id FROM (SELECT call_ord, u.id, 0 AS w FROM cal c JOIN ucl u ON u.name = c.callee_name WHERE branch = 'bare' UNION ALL SELECT call_ord, u.id, 1 FROM cal c JOIN ufn u ON u.name = c.callee_name WHERE branch = 'bare') GROUP BY call_ord),
cand AS (SELECT *, 0 AS p FROM r_super UNION ALL SELECT *, 1 FROM r_self UNION ALL SELECT *, 2 FROM r_module UNION ALL SELECT *, 3 FROM r_param UNION ALL SELECT *, 4 FROM r_instance UNION ALL SELECT *, 5 FROM r_scope UNION ALL SELECT *, 6 FROM r_unique
  UNION ALL SELECT *, 1 FROM r_bare UNION ALL SELECT *, 2 FROM r_same UNION ALL SELECT *, 3 FROM r_name),
rall AS (SELECT call_ord, arg_min(target_id, p) AS target_id FROM cand GROUP BY call_ord)
"""


def rule(name: str, table: str, run) -> None:  # noqa: ANN001
    """Register one resolution rule: (call_ord, target_id) in both engines."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        i = Inputs(spark, sf_dir)
        return i.once(name, lambda: run(i).select("call_ord", "target_id"))

    go.__name__ = name
    query(SQL + f"SELECT call_ord, target_id FROM {table}")(go)


@query(INPUTS + "SELECT file_path, name, arg_max(id, sym_ord) AS id FROM rsym GROUP BY file_path, name")
def symbols_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.by_file_and_name(Inputs(spark, sf_dir).symbols).select("file_path", "name", "id")


@query(SQL + "SELECT imp_ord, m.p AS path FROM rel")
def resolve_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return R.resolve_relative(i.imports, i.files)


@query(SQL + "SELECT imp_ord, path FROM exa")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return R.resolve_exact(i.imports, i.files)


@query(SQL + "SELECT imp_ord, path FROM suf")
def resolve_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return R.resolve_suffix(i.imports, i.files)


@query(SQL + "SELECT imp_ord, path FROM sub")
def resolve_submodule(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return R.resolve_suffix(i.imports, i.files, submodule=True)


@query(SQL + "SELECT file_path, name, target_id FROM sloc")
def scope_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scope_local(Inputs(spark, sf_dir).symbols).select("file_path", "name", "target_id")


@query(SQL + "SELECT file_path, name, target_id FROM swil")
def scope_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.once("wildcard", lambda: R.scope_wildcard(i.imports, i.resolved(), i.symbols).select("file_path", "name", "target_id"))


@query(SQL + "SELECT file_path, name, m.k AS kind, m.t AS target_id, m.f AS target_file FROM sfro")
def scope_from_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.once("from", lambda: R.scope_from_import(i.imports, i.resolved(), i.symbols).select("file_path", "name", "kind", "target_id", "target_file"))


@query(SQL + "SELECT file_path, name, target_file FROM smod")
def scope_module_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.once("module", lambda: R.scope_module_import(i.imports, i.resolved()).select("file_path", "name", "target_file"))


@query(SQL + "SELECT class_id, ancestor_id, min(depth)::INTEGER AS depth FROM anc GROUP BY class_id, ancestor_id")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).closure().select("class_id", "ancestor_id", "depth")


@query(SQL + "SELECT class_id, name, id FROM meth")
def resolve_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.methods().select("class_id", "name", "id")


def _super(i: Inputs) -> DataFrame:
    return R.rule_super(i.split(), i.closure(), i.methods())


def _hints(i: Inputs) -> DataFrame:
    return R.hinted(i.split(), i.params, i.scope(), i.symbols)


def _instance(i: Inputs) -> DataFrame:
    classes = i.symbols.where("kind = 'class'").select(F.col("id").alias("target_id"))
    named = i.scope().where("kind = 'symbol'").join(classes, "target_id", "left_semi").select("file_path", F.col("name").alias("callee_name"), F.col("target_id").alias("class_id"))
    created = i.calls.select("caller_id", "file_path", "callee_name", F.col("call_ord").alias("ord")).join(named, ["file_path", "callee_name"]).select("caller_id", "class_id", "ord")
    return R.rule_instance(i.split(), _hints(i), created, i.symbols, i.methods())


rule("resolve_super", "r_super", _super)
rule("resolve_self", "r_self", lambda i: R.rule_self(i.split(), i.methods()))
rule("resolve_module_attr", "r_module", lambda i: R.rule_module(i.split(), i.scope(), i.symbols))
rule("resolve_param_type", "r_param", lambda i: R.rule_param(_hints(i), i.methods()))
rule("resolve_instance", "r_instance", _instance)
rule("resolve_scope_class", "r_scope", lambda i: R.rule_scope_class(i.split(), i.scope(), i.symbols, i.methods()))
rule("resolve_unique_method", "r_unique", lambda i: R.rule_unique_method(i.split(), i.symbols))
rule("resolve_bare_scope", "r_bare", lambda i: R.rule_bare_scope(i.split(), i.scope()))
rule("resolve_same_file", "r_same", lambda i: R.rule_same_file(i.split(), i.symbols))
rule("resolve_unique_name", "r_name", lambda i: R.best(R.rule_unique_name(i.split(), i.symbols)))


def _all(i: Inputs) -> DataFrame:
    return R.resolve_calls(i.calls, i.imports, i.files, i.symbols, i.bases, i.params)


rule("resolve_all", "rall", _all)


@query(SQL + "SELECT parent_class_id AS source, id AS target FROM rsym WHERE parent_class_id IS NOT NULL")
def edges_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.contains_edges(Inputs(spark, sf_dir).symbols).select("source", "target")


@query(SQL + "SELECT class_id AS source, parent_id AS target FROM lnk")
def edges_inherits(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return R.inherits_edges(i.links()).select("source", "target")


CALLS = "SELECT caller_id AS source, target_id AS target, CASE WHEN s.kind = 'class' THEN 'instantiates' ELSE 'calls' END AS kind, min(c.call_ord) AS edge_ord FROM rall JOIN rcall c USING (call_ord) JOIN rsym s ON s.id = target_id GROUP BY 1, 2, 3"


@query(SQL + CALLS)
def edges_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.once("edges", lambda: R.call_edges(i.calls, _all(i), i.symbols).select("source", "target", "kind", "edge_ord"))


@query(INPUTS + "SELECT DISTINCT source, target FROM calls_raw")
def edges_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestar.operators.graph import keep_first
    from lodestar.plans.canonical import usages as raw

    return keep_first(raw(spark, sf_dir).select(F.col("caller_symbol_id").alias("source"), F.col("target_id").alias("target"), "edge_ord"), ["source", "target"], "edge_ord").select("source", "target")


@query(SQL + "SELECT target_id, caller_id AS caller_symbol_id, line FROM rall JOIN rcall USING (call_ord)")
def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return i.once("usages", lambda: R.usage_rows(i.calls, _all(i)).select("target_id", "caller_symbol_id", "line"))


@query(SQL + "SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY c.line)::INTEGER AS step, target_id FROM rcall c LEFT JOIN rall USING (call_ord) WHERE c.line % 50 = 0")
def pipeline_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth call stands for a module-level step."""
    from pyspark.sql import Window as W

    i = Inputs(spark, sf_dir)
    own = i.calls.where("line % 50 = 0").withColumn("step", F.row_number().over(W.partitionBy("file_path").orderBy("line")))
    return i.once("steps", lambda: own.join(_all(i), "call_ord", "left").select("file_path", "step", "target_id"))


@query(INPUTS + "SELECT DISTINCT file_path FROM rcall WHERE line % 50 = 0")
def script_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).calls.where("line % 50 = 0").select("file_path").distinct()


@query(INPUTS + "SELECT file_path, string_agg(callee_name, ' > ' ORDER BY line) AS pipeline FROM rcall WHERE line % 50 = 0 GROUP BY file_path")
def script_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Inputs(spark, sf_dir).calls.where("line % 50 = 0")
    return own.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "callee_name"))), lambda x: x["callee_name"]), " > ").alias("pipeline"))
