"""Name resolution: a cascade of joins from call sites and imports to symbols.

Every rule gives candidates (call_ord, prio, sub_ord, target_id) and one aggregation takes the
best of each call. Suffix matches are equi-joins on exploded path suffixes, 'first match wins'
is a minimum over an explicit order, and 'globally unique' is a count of one.

Inputs: files(file_path, file_ord); symbols(id, name, kind, file_path, parent_class_id, is_exported, sym_ord);
imports(file_path, module_name, imported_symbol, alias, is_wildcard, level, imp_ord);
call_sites(call_ord, file_path, caller_id, callee_name, line, col); bases(class_id, base, base_ord).
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.sources.stages import stage

METHODS = ("method", "class_method", "static_method")


def first_by(df: DataFrame, keys: list[str], value: str, order: Column, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(out or value))


def by_file_and_name(symbols: DataFrame) -> DataFrame:
    """(file_path, name, id, kind): the last definition of a name in a file."""
    return symbols.groupBy("file_path", "name").agg(F.max_by(F.struct("id", "kind"), "sym_ord").alias("s")).select("file_path", "name", "s.id", "s.kind")


def unique_names(symbols: DataFrame) -> DataFrame:
    """(name, id): names that one symbol alone has."""
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("name", "id")


def module_path(module: Column) -> Column:
    return F.replace(module, F.lit("."), F.lit("/"))


def folder_up(path: Column, level: Column) -> Column:
    """The folder of a file, ``level`` - 1 folders up; '' is the top."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), "/")


def below(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", F.nullif(folder, F.lit("")), F.nullif(name, F.lit("")))


def match_paths(imports: DataFrame, paths: Column, files: DataFrame) -> DataFrame:
    """(imp_ord, path): the first of each import's candidate ``paths`` that is a file."""
    spread = imports.select("imp_ord", F.posexplode(F.array_compact(paths)).alias("cand", "want"))
    return spread.join(files.select(F.col("file_path").alias("__f")), F.col("want") == F.col("__f")).groupBy("imp_ord").agg(F.min_by("want", "cand").alias("path"))


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """from ..m import s: the module, its package, the bare path, then s below it; from . import s looks for s first."""
    folder, module = folder_up(F.col("file_path"), F.col("level")), module_path(F.coalesce("module_name", F.lit("")))
    base = below(folder, module)
    child = F.when(F.col("imported_symbol").isNotNull(), F.concat(below(base, F.col("imported_symbol")), F.lit(".py")))
    package = below(base, F.lit("__init__.py"))
    named = F.array(F.concat(base, F.lit(".py")), package, base, child)
    return match_paths(imports.where("level > 0"), F.when(module == "", F.array(child, package)).otherwise(named), files)


def resolve_exact(imports: DataFrame, files: DataFrame) -> DataFrame:
    base = module_path(F.col("module_name"))
    return match_paths(imports.where("module_name <> ''"), F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py"))), files)


def suffixes(files: DataFrame) -> DataFrame:
    """(suffix, file_path, file_ord): every path suffix of every file, for suffix matches by equality."""
    parts = F.split("file_path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return files.select("file_path", "file_ord", F.explode(tails).alias("suffix"))


def resolve_suffix(imports: DataFrame, files: DataFrame, submodule: bool = False) -> DataFrame:
    """(imp_ord, path): the first file that ends in the module's path (or in the imported symbol's below it)."""
    base = module_path(F.col("module_name"))
    want = F.concat(base, F.lit("/"), F.col("imported_symbol"), F.lit(".py")) if submodule else F.concat(base, F.lit(".py"))
    own = imports.where("module_name <> ''").select("imp_ord", want.alias("want")).where("want is not null")
    return own.join(suffixes(files), F.col("want") == F.col("suffix")).groupBy("imp_ord").agg(F.min_by("file_path", "file_ord").alias("path"))


def folded_path(folder: Column, module: Column) -> Column:
    """``module`` below ``folder`` with '.' and '..' worked off on a stack of segments; null above the top."""
    parts = F.concat(F.split(folder, "/"), F.split(module, "/"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("inside"))

    def step(seen: Column, part: Column) -> Column:
        stack, up = seen["stack"], part == ".."
        kept = F.when(part.isin("", "."), stack).when(up, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))
        return F.struct(kept.alias("stack"), (seen["inside"] & ~(up & (F.size(stack) == 0))).alias("inside"))

    done = F.aggregate(parts, start, step)
    return F.when(done["inside"], F.array_join(done["stack"], "/"))


#: fixed values: endings that a script module may be written without, in the order in which they are tried
SCRIPT_ENDINGS = ("ts", "tsx", "js", "jsx")


def resolve_script(imports: DataFrame, files: DataFrame) -> DataFrame:
    """import s from '../m': the path as it stands, with each ending, the TypeScript source of a .js path, then m/index."""
    own = imports.where(F.col("module_name").rlike(r"^\.{1,2}(/|$)"))
    base = folded_path(folder_up(F.col("file_path"), F.lit(1)), F.col("module_name"))
    source = F.when(base.rlike(r"\.jsx?$"), F.regexp_replace(base, r"\.js(x?)$", ".ts$1"))
    endings = [F.concat(base, F.lit(f".{e}")) for e in SCRIPT_ENDINGS]
    return match_paths(own, F.array(base, *endings, source, *[F.concat(below(base, F.lit("index")), F.lit(f".{e}")) for e in SCRIPT_ENDINGS]), files)


def resolve_imports(imports: DataFrame, files: DataFrame, resolve_ts_paths: bool = False) -> DataFrame:
    """(imp_ord, path): the file of each import; relative, exact, suffix, then submodule matches.

    With ``resolve_ts_paths`` the relative modules of scripts are found too; without, as originally
    observed, scripts are linked by names alone.
    """
    ways = [resolve_relative(imports, files), resolve_exact(imports, files), resolve_suffix(imports, files), resolve_suffix(imports, files, submodule=True)]
    if resolve_ts_paths:
        ways.append(resolve_script(imports, files))
    found = reduce(DataFrame.unionByName, [w.withColumn("way", F.lit(i)) for i, w in enumerate(ways)])
    return found.groupBy("imp_ord").agg(F.min_by("path", "way").alias("path"))


SCOPE = ["file_path", "name", "kind", "target_id", "target_file", "ord"]


def scope_local(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'class'").groupBy("file_path", "name").agg(F.max_by("id", "sym_ord").alias("target_id"), F.max("sym_ord").alias("ord")).select("file_path", "name", F.lit("symbol").alias("kind"), "target_id", F.lit(None).cast("string").alias("target_file"), "ord")


def scope_wildcard(imports: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """Exported names of a wildcard import; earlier imports win."""
    own = imports.where("is_wildcard").join(resolved, "imp_ord").groupBy("file_path", "path").agg(F.min("imp_ord").alias("imp_ord"))
    exported = symbols.where("is_exported").groupBy(F.col("file_path").alias("__p"), "name").agg(F.min(F.struct("sym_ord", "id")).alias("s"))
    # many imports offer one name, so the first is sought among numbers alone; what it offers is joined to the few that are left
    first = own.join(exported.select("__p", "name"), F.col("path") == F.col("__p")).groupBy("file_path", "name").agg(F.min("imp_ord").alias("imp_ord"))
    met = first.join(own, ["file_path", "imp_ord"]).join(exported.withColumnRenamed("__p", "path"), ["path", "name"])
    return met.groupBy("file_path", "name").agg(F.min(F.struct("imp_ord", "s")).alias("m")).select("file_path", "name", F.lit("symbol").alias("kind"), F.col("m.s.id").alias("target_id"), F.lit(None).cast("string").alias("target_file"), F.col("m.imp_ord").alias("ord"))


def scope_from_import(imports: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """from x import y [as z]: the symbol, or the module where y is a file; later imports win."""
    own = imports.where("imported_symbol is not null and not is_wildcard").join(resolved, "imp_ord")
    first = first_by(symbols, ["file_path", "name"], "id", F.col("sym_ord")).select(F.col("file_path").alias("__p"), F.col("name").alias("__n"), "id")
    named = own.join(first, (F.col("path") == F.col("__p")) & (F.col("imported_symbol") == F.col("__n")), "left")
    is_file = F.regexp_replace("path", r"(/__init__)?\.py$", "").endswith(F.concat(F.lit("/"), F.col("imported_symbol"))) | (F.col("path") == F.concat("imported_symbol", F.lit(".py")))
    kept = named.where(F.col("id").isNotNull() | is_file)
    item = F.struct(F.when(F.col("id").isNotNull(), F.lit("symbol")).otherwise(F.lit("module")).alias("kind"), F.col("id").alias("target_id"), F.when(F.col("id").isNull(), F.col("path")).alias("target_file"))
    return kept.groupBy("file_path", F.coalesce("alias", "imported_symbol").alias("name")).agg(F.max_by(item, "imp_ord").alias("m"), F.max("imp_ord").alias("ord")).select("file_path", "name", "m.kind", "m.target_id", "m.target_file", "ord")


def scope_module_import(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """import a.b [as c]: a module under its alias or last part."""
    own = imports.where("imported_symbol is null and not is_wildcard").join(resolved, "imp_ord")
    return own.groupBy("file_path", F.coalesce("alias", F.element_at(F.split("module_name", r"\."), -1)).alias("name")).agg(F.max_by("path", "imp_ord").alias("target_file"), F.max("imp_ord").alias("ord")).select("file_path", "name", F.lit("module").alias("kind"), F.lit(None).cast("string").alias("target_id"), "target_file", "ord")


def scopes(imports: DataFrame, files: DataFrame, symbols: DataFrame, resolve_ts_paths: bool = False) -> DataFrame:
    """(file_path, name, kind, target_id, target_file, ord): what a name means at the top of a file.

    The last import of a name holds, then a local class, then a wildcard. ``ord`` is the place
    at which the name first came up: local classes, then imports.
    """
    resolved = stage(resolve_imports(imports, files, resolve_ts_paths), "resolve-imports")
    layers = [(0, 1, scope_wildcard(imports, resolved, symbols)), (1, 0, scope_local(symbols)), (2, 1, scope_module_import(imports, resolved)), (2, 1, scope_from_import(imports, resolved, symbols))]
    both = reduce(DataFrame.unionByName, [x.select(*SCOPE).withColumn("layer", F.lit(l)).withColumn("place", F.struct(F.lit(p).alias("late"), "ord")) for l, p, x in layers])
    item = F.max_by(F.struct("kind", "target_id", "target_file"), F.struct("layer", "ord"))
    return both.groupBy("file_path", "name").agg(item.alias("m"), F.min("place").alias("ord")).select("file_path", "name", "m.*", "ord")


def base_links(bases: DataFrame, symbols: DataFrame, scope: DataFrame) -> DataFrame:
    """(class_id, parent_id, base_ord): each base by scope, then same file, then globally unique class."""
    classes = symbols.where("kind = 'class'")
    own = bases.join(classes.select(F.col("id").alias("class_id"), "file_path"), "class_id")
    in_scope = scope.where("kind = 'symbol'").join(classes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("file_path", F.col("name").alias("base"), F.col("target_id").alias("t"))
    same = by_file_and_name(classes).select("file_path", F.col("name").alias("base"), F.col("id").alias("t"))
    unique = unique_names(classes).select(F.col("name").alias("base"), F.col("id").alias("t"))
    found = own.join(in_scope, ["file_path", "base"]).select("class_id", "base_ord", "t", F.lit(0).alias("p"))
    found = found.unionByName(own.join(same, ["file_path", "base"]).select("class_id", "base_ord", "t", F.lit(1).alias("p"))).unionByName(own.join(unique, "base").select("class_id", "base_ord", "t", F.lit(2).alias("p")))
    return found.groupBy("class_id", "base_ord").agg(F.min_by("t", "p").alias("parent_id"))


def ancestors(links: DataFrame) -> DataFrame:
    """(class_id, ancestor_id, depth, ord): the closure in breadth-first order, without cycles."""
    up = stage(links.where("class_id <> parent_id").select(F.col("class_id").alias("c"), "parent_id", "base_ord"), "ancestry-links")
    level = reached = stage(up.groupBy(F.col("c").alias("class_id"), F.col("parent_id").alias("ancestor_id")).agg(F.lpad(F.min("base_ord").cast("string"), 10, "0").alias("ord")).withColumn("depth", F.lit(1)), "ancestry-1")
    for depth in count(2):
        following = level.join(up, F.col("ancestor_id") == F.col("c")).where("parent_id <> class_id").groupBy("class_id", F.col("parent_id").alias("a")).agg(F.min(F.concat("ord", F.lit("."), F.lpad(F.col("base_ord").cast("string"), 10, "0"))).alias("ord"))
        level = stage(following.withColumnRenamed("a", "ancestor_id").withColumn("depth", F.lit(depth)).join(reached.select("class_id", "ancestor_id"), ["class_id", "ancestor_id"], "left_anti").select("class_id", "ancestor_id", "ord", "depth"), f"ancestry-{depth}")
        if level.isEmpty():
            break
        reached = reached.select("class_id", "ancestor_id", "ord", "depth").unionByName(level)
    return reached.select("class_id", "ancestor_id", "depth", "ord")


def method_table(symbols: DataFrame, closure: DataFrame) -> DataFrame:
    """(class_id, name, id): what each class answers to, its own methods before inherited ones."""
    own = symbols.where("parent_class_id is not null").groupBy(F.col("parent_class_id").alias("owner"), "name").agg(F.min_by("id", "sym_ord").alias("id"))
    own = stage(own, "method-owners")
    # ancestors get numbers, so that the first with a name is a minimum of numbers; 0 is the class itself
    turns = closure.select("class_id", F.col("ancestor_id").alias("owner"), F.row_number().over(W.partitionBy("class_id").orderBy("depth", "ord")).alias("turn"))
    turns = stage(turns.unionByName(own.select(F.col("owner").alias("class_id"), "owner", F.lit(0).alias("turn")).distinct()), "method-turns")
    # an owner's names travel as one row and are spread where a class has all of its ancestors: a root that all classes come
    # from would otherwise meet every class in one task, which would have to hold a group for each of them and each name
    told = turns.join(own.groupBy("owner").agg(F.collect_list("name").alias("names")), "owner").select("class_id", "turn", "names")
    first = told.repartition("class_id").select("class_id", "turn", F.explode("names").alias("name")).groupBy("class_id", "name").agg(F.min("turn").alias("turn"))
    return first.join(turns, ["class_id", "turn"]).join(own, ["owner", "name"]).select("class_id", "name", "id")


def split_calls(call_sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with branch (super, dotted, bare), receiver, method and the caller's class."""
    caller = symbols.groupBy(F.col("id").alias("caller_id")).agg(F.max_by("parent_class_id", "sym_ord").alias("class_id"))
    name = F.col("callee_name")
    branch = F.when(name.startswith("super().") & F.col("class_id").isNotNull(), F.lit("super")).when(F.contains(name, F.lit(".")), F.lit("dotted")).otherwise(F.lit("bare"))
    parts = F.split(name, r"\.", 2)
    return call_sites.join(caller, "caller_id", "left").withColumn("branch", branch).withColumn("receiver", F.get(parts, F.lit(0))).withColumn("method", F.get(parts, F.lit(1)))


def pick(df: DataFrame, prio: int, target: str = "target_id", sub: Column | None = None) -> DataFrame:
    return df.select("call_ord", F.lit(prio).alias("prio"), (F.lit(0) if sub is None else sub).cast("long").alias("sub_ord"), F.col(target).alias("target_id"))


def rule_super(calls: DataFrame, closure: DataFrame, methods: DataFrame) -> DataFrame:
    """super().m: the first ancestor, in breadth-first order, whose own hierarchy has m."""
    own = calls.where("branch = 'super'").select("call_ord", "class_id", F.substring_index("callee_name", ".", -1).alias("m"))
    found = own.join(closure, "class_id").join(methods.select(F.col("class_id").alias("ancestor_id"), F.col("name").alias("m"), "id"), ["ancestor_id", "m"])
    return found.groupBy("call_ord").agg(F.min_by("id", F.struct("depth", "ord")).alias("target_id")).select("call_ord", F.lit(0).alias("prio"), F.lit(0).cast("long").alias("sub_ord"), "target_id")


def rule_self(calls: DataFrame, methods: DataFrame) -> DataFrame:
    own = calls.where("branch = 'dotted' and receiver in ('self', 'cls') and class_id is not null").withColumn("m", F.get(F.split("callee_name", r"\."), F.lit(1)))
    return pick(own.join(methods.select("class_id", F.col("name").alias("m"), F.col("id").alias("target_id")), ["class_id", "m"]), 1)


def rule_module(calls: DataFrame, scope: DataFrame, symbols: DataFrame) -> DataFrame:
    modules = scope.where("kind = 'module'").select("file_path", F.col("name").alias("receiver"), F.col("target_file").alias("tf"))
    first = first_by(symbols, ["file_path", "name"], "id", F.col("sym_ord")).select(F.col("file_path").alias("tf"), F.col("name").alias("method"), F.col("id").alias("target_id"))
    return pick(calls.where("branch = 'dotted'").join(modules, ["file_path", "receiver"]).join(first, ["tf", "method"]), 2)


def hinted(calls: DataFrame, params: DataFrame, scope: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call_ord, method, class_id): the class that the receiver's parameter hint names, by scope or globally unique."""
    classes = symbols.where("kind = 'class'")
    own = calls.where("branch = 'dotted'").select("call_ord", "file_path", "caller_id", "receiver", "method").join(params.select(F.col("id").alias("caller_id"), F.col("param").alias("receiver"), "type_hint"), ["caller_id", "receiver"])
    in_scope = scope.where("kind = 'symbol'").join(classes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("file_path", F.col("name").alias("type_hint"), F.col("target_id").alias("s"))
    unique = unique_names(classes).select(F.col("name").alias("type_hint"), F.col("id").alias("u"))
    return own.join(in_scope, ["file_path", "type_hint"], "left").join(unique, "type_hint", "left").select("call_ord", "method", F.coalesce("s", "u").alias("class_id")).where("class_id is not null")


def rule_param(hints: DataFrame, methods: DataFrame) -> DataFrame:
    return pick(hints.join(methods.select("class_id", F.col("name").alias("method"), F.col("id").alias("target_id")), ["class_id", "method"]), 3)


def rule_instance(calls: DataFrame, hints: DataFrame, created: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """A class that the same caller creates and that has the method; a similar name first, else the first created.

    ``created(caller_id, class_id, ord)`` are the caller's calls of classes in scope.
    """
    own = calls.where("branch = 'dotted'").join(hints.select("call_ord"), "call_ord", "left_anti")
    named = created.join(symbols.where("kind = 'class'").select(F.col("id").alias("class_id"), F.lower("name").alias("cn")).distinct(), "class_id")
    met = own.drop("class_id").join(named, "caller_id").join(methods.select("class_id", F.col("name").alias("method"), F.col("id").alias("target_id")), ["class_id", "method"])
    r = F.lower("receiver")
    alike = F.contains(r, F.col("cn")) | F.contains(F.col("cn"), r)
    return met.groupBy("call_ord").agg(F.min_by("target_id", F.struct((~alike).cast("int"), "ord")).alias("target_id")).select("call_ord", F.lit(4).alias("prio"), F.lit(0).cast("long").alias("sub_ord"), "target_id")


def rule_scope_class(calls: DataFrame, scope: DataFrame, symbols: DataFrame, methods: DataFrame) -> DataFrame:
    """The first class in scope that has the method. Joined on (file, method), so a file's classes that lack it cost nothing."""
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("target_id")).distinct()
    own = calls.where("branch = 'dotted'")
    asked = own.select(F.col("method").alias("name")).distinct()
    answers = methods.join(asked, "name", "left_semi").select("class_id", F.col("name").alias("method"), F.col("id").alias("t"))
    # classes of a file get numbers, so that the first with a method is a minimum of numbers, taken before anything is exchanged
    seen = scope.where("kind = 'symbol'").join(classes, "target_id", "left_semi").groupBy("file_path", F.col("target_id").alias("class_id")).agg(F.min("ord").alias("ord"))
    seen = stage(seen.withColumn("turn", F.row_number().over(W.partitionBy("file_path").orderBy("ord", "class_id"))).drop("ord"), "resolve-turns")
    first = seen.join(answers.select("class_id", "method"), "class_id").groupBy("file_path", "method").agg(F.min("turn").alias("turn"))
    offers = first.join(seen, ["file_path", "turn"]).join(answers, ["class_id", "method"]).select("file_path", "method", F.col("t").alias("target_id"))
    return pick(own.join(offers, ["file_path", "method"]), 5)


def rule_unique_method(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return pick(calls.where("branch = 'dotted'").join(unique_names(symbols).select(F.col("name").alias("method"), F.col("id").alias("target_id")), "method"), 6)


def rule_bare_scope(calls: DataFrame, scope: DataFrame) -> DataFrame:
    return pick(calls.where("branch = 'bare'").join(scope.where("kind = 'symbol'").select("file_path", F.col("name").alias("callee_name"), "target_id"), ["file_path", "callee_name"]), 1)


def rule_same_file(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return pick(calls.where("branch = 'bare'").join(by_file_and_name(symbols).select("file_path", F.col("name").alias("callee_name"), F.col("id").alias("target_id")), ["file_path", "callee_name"]), 2)


def rule_unique_name(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """A globally unique class, then a globally unique function or method."""
    classes = unique_names(symbols.where("kind = 'class'")).withColumn("sub", F.lit(0))
    functions = unique_names(symbols.where("kind <> 'class'")).withColumn("sub", F.lit(1))
    both = classes.unionByName(functions).select(F.col("name").alias("callee_name"), F.col("id").alias("target_id"), "sub")
    return pick(calls.where("branch = 'bare'").join(both, "callee_name"), 3, sub=F.col("sub"))


def best(found: DataFrame) -> DataFrame:
    return found.groupBy("call_ord").agg(F.min_by("target_id", F.struct("prio", "sub_ord")).alias("target_id"))


def resolve_calls(call_sites: DataFrame, imports: DataFrame, files: DataFrame, symbols: DataFrame, bases: DataFrame, params: DataFrame, resolve_ts_paths: bool = False) -> DataFrame:
    """(call_ord, target_id): at most one target per call."""
    scope = stage(scopes(imports, files, symbols, resolve_ts_paths), "resolve-scope")
    closure = ancestors(base_links(bases, symbols, scope))
    methods = stage(method_table(symbols, closure), "resolve-methods")
    calls = stage(split_calls(call_sites, symbols), "resolve-calls")
    bare = reduce(DataFrame.unionByName, [rule_bare_scope(calls, scope), rule_same_file(calls, symbols), rule_unique_name(calls, symbols)])
    bare = stage(best(bare), "resolve-bare")
    classes = symbols.where("kind = 'class'").select(F.col("id").alias("target_id")).distinct()
    class_names = scope.where("kind = 'symbol'").join(classes, "target_id", "left_semi").select("file_path", F.col("name").alias("callee_name"), F.col("target_id").alias("class_id"))
    created = calls.select("caller_id", "file_path", "callee_name", "call_ord").join(class_names, ["file_path", "callee_name"]).select("caller_id", "class_id", F.col("call_ord").alias("ord"))
    hints = hinted(calls, params, scope, symbols)
    dotted = [rule_super(calls, closure, methods), rule_self(calls, methods), rule_module(calls, scope, symbols), rule_param(hints, methods), rule_instance(calls, hints, created, symbols, methods), rule_scope_class(calls, scope, symbols, methods), rule_unique_method(calls, symbols)]
    return best(reduce(DataFrame.unionByName, dotted)).unionByName(bare)


def contains_edges(symbols: DataFrame) -> DataFrame:
    return symbols.where("parent_class_id is not null").select(F.col("parent_class_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.col("sym_ord").alias("edge_ord"))


def inherits_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("class_id").alias("source"), F.col("parent_id").alias("target"), F.lit("inherits").alias("kind"), F.col("base_ord").cast("long").alias("edge_ord"))


def call_edges(call_sites: DataFrame, resolved: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls and instantiates edges; of equal edges the first call site stays."""
    kinds = symbols.groupBy(F.col("id").alias("target_id")).agg(F.max_by("kind", "sym_ord").alias("tk"))
    joined = call_sites.join(resolved, "call_ord").join(kinds, "target_id")
    kind = F.when(F.col("tk") == "class", F.lit("instantiates")).otherwise(F.lit("calls"))
    return joined.groupBy(F.col("caller_id").alias("source"), F.col("target_id").alias("target"), kind.alias("kind")).agg(F.min(F.struct("call_ord", "line", "col")).alias("c")).select("source", "target", "kind", F.col("c.call_ord").alias("edge_ord"), "c.line", "c.col")


def usage_rows(call_sites: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row per target and location, the first of each."""
    joined = call_sites.join(resolved, "call_ord")
    return joined.groupBy("target_id", "file_path", "line", "col").agg(F.min(F.struct("call_ord", "caller_id")).alias("c")).select("target_id", F.col("c.caller_id").alias("caller_symbol_id"), "file_path", "line", "col", F.col("c.caller_id").endswith("#<module>").alias("is_top_level_script"))
