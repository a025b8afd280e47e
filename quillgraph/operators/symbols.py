"""The symbol graph: resolution of references, dependencies, coupling, reach and staleness.

A symbol row is (id, name, kind, role, chunk_id, document_path, line_number, container), a role being 'definition' or
'reference'.  Rows that repeat an id count once; rows without a name, role, chunk or path take no part.  An edge
(source_chunk_id, target_chunk_id, edge_type, symbol_name) says that the source's chunk refers to a symbol defined in
the target's.

Names that say little (keywords and built-in names) are left out of resolution; the list is a parameter.
"""

from __future__ import annotations

import builtins
import keyword

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import materialize

# Keywords and everyday names of other languages, which say little.
SCRIPT_NOISE = "console log error warn require module exports process document window setTimeout setInterval clearTimeout Promise resolve reject then catch finally JSON parse stringify Object Array String Number Boolean Math Date RegExp Map Set Symbol Error undefined null this arguments push pop shift slice splice forEach filter reduce concat indexOf includes toString hasOwnProperty addEventListener".split()
JAVA_NOISE = "System out println Integer Long Double List ArrayList HashMap Optional Override equals hashCode valueOf getClass length size stream collect".split()
GO_NOISE = "make append cap panic recover nil err fmt Println Printf Sprintf Errorf string int bool byte error".split()
RUST_NOISE = "Some None Ok Err unwrap expect clone into iter vec println format Box Rc Arc Vec String Self self".split()
COMMON_NOISE = "get set add remove update delete create init run start stop close read write name value key data item items args kwargs self cls config options result test main".split()
#: Names that say little: by rule, Python's keywords and public built-ins, and the lists above.
NOISE = sorted({*keyword.kwlist, *(x for x in dir(builtins) if not x.startswith("_")), *SCRIPT_NOISE, *JAVA_NOISE, *GO_NOISE, *RUST_NOISE, *COMMON_NOISE})


def cleaned(symbols: DataFrame) -> DataFrame:
    """Symbols with trimmed names, lower-case roles and one row an id."""
    s = symbols.withColumns({"name": F.trim("name"), "role": F.lower(F.trim("role"))}).dropDuplicates(["id"])
    return s.where(F.col("name").isNotNull() & F.col("role").isNotNull() & F.col("chunk_id").isNotNull() & F.col("document_path").isNotNull())


def module_suffixes(path: Column) -> Column:
    """All whole-segment suffixes of a path: what a module name can be equal to, so that matching is an equi-join."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


# What a relative or a web module name may be short for.
SCRIPT_ENDINGS = ("", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts")
WEB_ENDINGS = ".js .jsx .ts .tsx .mjs .cjs .css .scss .less".split()


def module_keys(name: Column) -> Column:
    """The path suffixes that a module name may stand for: dotted names, ./ and ../ names, bare web paths."""
    dotted = F.replace(name, F.lit("."), F.lit("/"))
    relative = F.regexp_replace(name, r"^(?:\.{1,2}/)+", "")
    web = F.regexp_replace(name, "^/+", "")
    is_web = F.lit(False)
    for e in WEB_ENDINGS:
        is_web = is_web | F.endswith(web, F.lit(e))
    keys = F.array(F.concat(dotted, F.lit(".py")), F.concat(dotted, F.lit("/__init__.py")))
    scripts = F.array(*[F.concat(relative, F.lit(e)) for e in SCRIPT_ENDINGS])
    return F.array_distinct(F.when(name.rlike(r"^\.{1,2}/"), F.when(relative != "", scripts).otherwise(F.array().cast("array<string>"))).otherwise(F.when(is_web, F.array_append(keys, web)).otherwise(keys)))


def module_matches(modules: DataFrame, paths: DataFrame) -> DataFrame:
    """(module, path): the paths that each module name may mean, by an equi-join on path suffixes."""
    m = modules.select(F.col("module"), F.explode(module_keys(F.col("module"))).alias("key"))
    p = paths.select(F.col("path"), F.explode(module_suffixes(F.col("path"))).alias("key"))
    return m.join(p, "key").select("module", "path").distinct()


def resolve(symbols: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """The distinct edges of all references.

    A reference meets the definitions of its name.  Among several it prefers those of its own container, then those in
    files that its chunk imports, where there are such; an import without a definition of its name leads to the first
    chunk of the file it names.  References within a chunk are no edges.

    References are reduced to (chunk, name, container) before the join, and definitions to (chunk, name, container), so
    a hot name costs its distinct pairs only; that many edges are the result, and they come out of the join distinct
    (``_edges_of``), so pairs are not shuffled.  The cleaned symbols and the definitions are written once.
    """
    s = materialize(cleaned(symbols).select("id", "name", "kind", "role", "chunk_id", "document_path", "container"), "symbols")
    bad = NOISE if noise is None else noise
    refs = s.where((F.col("role") == "reference") & (F.char_length("name") >= 2) & ~F.col("name").isin(bad)).select("chunk_id", "document_path", "name", "container").distinct()
    defs = s.where(F.col("role") == "definition").select(F.col("chunk_id").alias("target"), F.col("document_path").alias("target_path"), "name", F.col("container").alias("target_container")).distinct()
    defs = materialize(defs, "definitions")
    modules = s.where((F.col("role") == "reference") & (F.col("kind") == "module")).select("chunk_id", "document_path", F.col("name").alias("module")).distinct()
    matches = module_matches(modules.select("module").distinct(), defs.select(F.col("target_path").alias("path")).distinct())
    hinted = modules.join(matches, "module").select("chunk_id", F.col("path").alias("target_path")).distinct()
    first = s.where(F.col("role") == "definition").groupBy(F.col("document_path").alias("path")).agg(F.min_by("chunk_id", "id").alias("target"))
    lost = modules.join(defs.select(F.col("name").alias("module")).distinct(), "module", "left_anti").join(matches, "module").join(first, "path")
    files = lost.groupBy("chunk_id", "document_path", "module").agg(F.min_by("target", "path").alias("target"), F.min("path").alias("target_path"))
    # a module that is led to a file has no definition of its name, so no edge is among both
    return _edges_of(refs, defs, hinted).unionByName(_edge_rows(files.withColumnRenamed("module", "name")).distinct())


def _edge_rows(pairs: DataFrame) -> DataFrame:
    """The edges of (chunk_id, document_path, name, target, target_path), as often as the pairs come."""
    kind = F.when(F.col("document_path") == F.col("target_path"), "intra_file").otherwise("cross_file")
    return pairs.where(F.col("chunk_id") != F.col("target")).select(F.col("chunk_id").alias("source_chunk_id"), F.col("target").alias("target_chunk_id"), kind.alias("edge_type"), F.col("name").alias("symbol_name"))


def _edges_of(refs: DataFrame, defs: DataFrame, hinted: DataFrame) -> DataFrame:
    """The distinct edges of references to the definitions they prefer: of their own container if there are any, then in imported files if there are any, else all of the name.

    The keys of a preference are keys of its join (name and container, name and imported file), so a hot name is met in full
    only by references without either.  ``hinted`` is (chunk_id, target_path).

    What a reference meets is decided by its key (chunk, name, container) before any join that may multiply.  All files of
    a chunk that meet a whole name, or a name and container, are one row, and so are those of a target: the join has each
    pair once.  What comes in files that meet the whole name anyway adds nothing and is left out.  Only the few chunks whose
    references of one name are decided in several ways, and what imports lead to, go through a distinct.
    """
    bare = {"_c": F.coalesce("container", F.lit("")), "_n": F.col("container").isNull()}
    refs = refs.join(defs.select("name").distinct(), "name", "left_semi")
    held = defs.where(F.col("target_container").isNotNull()).select("name", F.col("target_container").alias("container"), F.lit(True).alias("_own")).distinct()
    r = refs.join(held, ["name", "container"], "left").withColumn("_own", F.col("_own").isNotNull())
    # a module that a chunk imports leads it to the definitions of one file, within the container if that has any
    led = r.join(hinted, "chunk_id").join(defs, ["name", "target_path"]).where(~F.col("_own") | F.coalesce(F.col("container") == F.col("target_container"), F.lit(False)))
    led = materialize(led.select(*refs.columns, "target", "target_path").distinct(), "led")
    done = led.withColumns(bare).select("chunk_id", "name", "_c", "_n").distinct().withColumn("_led", F.lit(True))
    r = r.withColumns(bare).join(done, ["chunk_id", "name", "_c", "_n"], "left").drop("_c", "_n")
    how = F.when(F.col("_led"), "led").when(F.col("_own"), "own").otherwise("all")
    places = lambda h: F.collect_set(F.when(F.col("how") == h, F.struct("document_path", "container")))
    g = r.withColumn("how", how).groupBy("chunk_id", "name").agg(places("all").alias("whole"), places("own").alias("own"), F.collect_set(F.when(F.col("how") == "led", F.col("document_path"))).alias("led"))
    g = g.withColumn("whole", F.array_distinct(F.transform("whole", lambda x: x["document_path"])))
    g = g.withColumns({"own": F.filter("own", lambda x: ~F.array_contains(F.col("whole"), x["document_path"])), "led": F.array_except("led", "whole")})
    ways = (F.size("whole") > 0).cast("int") + (F.size("own") > 0).cast("int") + (F.size("led") > 0).cast("int")
    g = materialize(g.withColumn("mixed", ways > 1), "met")
    # what the joins give is larger than what they read: their parts are set here, not by the sizes of their input
    parts = max(1, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    targets = defs.groupBy("name", "target").agg(F.collect_set("target_path").alias("paths")).repartition(parts, "name")
    whole = _pairs(g.where("NOT mixed AND size(whole) > 0").select("chunk_id", "name", F.col("whole").alias("files")).repartition(parts, "name").join(targets, "name"))
    in_container = defs.where(F.col("target_container").isNotNull()).groupBy("name", "target").agg(F.collect_set(F.struct(F.col("target_path").alias("document_path"), F.col("target_container").alias("container"))).alias("places"))
    in_container = in_container.select("name", "target", "places", F.explode(F.array_distinct(F.transform("places", lambda x: x["container"]))).alias("container"))
    of_own = g.where("NOT mixed AND size(own) > 0").select("chunk_id", "name", "own", F.explode(F.array_distinct(F.transform("own", lambda x: x["container"]))).alias("container"))
    own = _own_pairs(of_own.join(in_container, ["name", "container"]))
    # the rest: in several ways, or led
    m = g.where("mixed")
    rows = m.where("size(whole) > 0").select("chunk_id", "name", F.explode("whole").alias("document_path")).join(defs.drop("target_container").distinct(), "name")
    by_place = m.where("size(own) > 0").select("chunk_id", "name", F.explode("own").alias("_o")).select("chunk_id", "name", "_o.document_path", "_o.container")
    rows = rows.unionByName(by_place.join(defs.withColumnRenamed("target_container", "container"), ["name", "container"]).drop("container"))
    of_led = g.where("size(led) > 0").select("chunk_id", "name", F.explode("led").alias("document_path"))
    rows = rows.unionByName(led.drop("container").join(of_led, ["chunk_id", "name", "document_path"], "left_semi"))
    return whole.unionByName(own).unionByName(_edge_rows(rows).distinct())


def _typed(pairs: DataFrame, within: Column, across: Column) -> DataFrame:
    kinds = F.when(within & across, F.array(F.lit("intra_file"), F.lit("cross_file"))).when(within, F.array(F.lit("intra_file"))).otherwise(F.array(F.lit("cross_file")))
    return pairs.where(F.col("chunk_id") != F.col("target")).select(F.col("chunk_id").alias("source_chunk_id"), F.col("target").alias("target_chunk_id"), F.explode(kinds).alias("edge_type"), F.col("name").alias("symbol_name"))


def _pairs(met: DataFrame) -> DataFrame:
    """The edges of (chunk_id, name, files, target, paths): one of each kind that some file and some path make."""
    within = F.arrays_overlap("files", "paths")
    return _typed(met, within, ~within | (F.size("files") > 1) | (F.size("paths") > 1))


def _own_pairs(met: DataFrame) -> DataFrame:
    """The edges of (chunk_id, name, container, own, target, places), each pair told by the least container that both have."""
    cs = lambda c: F.transform(c, lambda x: x["container"])
    one = (F.size("own") == 1) | (F.size("places") == 1)
    least = F.when(one, F.col("container")).otherwise(F.array_min(F.array_intersect(cs("own"), cs("places"))))
    met = met.where(F.col("container") == least)
    within = F.arrays_overlap("own", "places")
    other = F.exists("own", lambda x: F.exists("places", lambda y: (x["container"] == y["container"]) & (x["document_path"] != y["document_path"])))
    simple = (F.size("own") == 1) & (F.size("places") == 1)
    return _typed(met, within, F.when(simple, ~within).otherwise(other))


def significant(name: Column, threshold: float = 0.0, excluded: list[str] | None = None) -> Column:
    """Whether a name counts: never if it is excluded, and with a threshold above 0 not if it says little."""
    ok = ~name.isin(excluded) if excluded else F.lit(True)
    return ok & ~name.isin(NOISE) if threshold > 0 else ok


def rebuilt(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """The edges after the chunks of ``changed`` (chunk_id) got new symbols: what they touch by name or by end is resolved anew, the rest stays.

    A name is touched if a changed chunk has it now or an old edge of a changed chunk bore it; module names are resolved
    through files, so chunks that import are resolved with all their names.
    """
    s, ids = cleaned(symbols), changed.select("chunk_id").distinct()
    mine = s.join(ids, "chunk_id", "left_semi").select("name")
    sides = [edges.join(ids.withColumnRenamed("chunk_id", c), c, "left_semi").select(F.col("symbol_name").alias("name")) for c in ("source_chunk_id", "target_chunk_id")]
    names = materialize(mine.unionByName(sides[0]).unionByName(sides[1]).unionByName(s.where((F.col("role") == "reference") & (F.col("kind") == "module")).select("name")).distinct(), "names")
    fresh = resolve(symbols).join(names.withColumnRenamed("name", "symbol_name"), "symbol_name", "left_semi")
    kept = edges.join(names.withColumnRenamed("name", "symbol_name"), "symbol_name", "left_anti")
    return kept.unionByName(fresh.select(edges.columns)).distinct()


def references_of(symbols: DataFrame, chunks: DataFrame, name: str | Column, preview: int = 200) -> DataFrame:
    """(id, role, kind, chunk_id, document_path, line_number, content_preview, verdict) of every use and definition of one name.

    The verdict is the same in all rows: referenced, unreferenced or external; a name that is nowhere has no rows.
    """
    own = cleaned(symbols).where(F.col("name") == name)
    d, r = F.max(F.col("role") == "definition").over(Window.partitionBy("name")), F.max(F.col("role") == "reference").over(Window.partitionBy("name"))
    verdict = F.when(d & r, "referenced").when(d, "unreferenced").otherwise("external")
    c = chunks.select("chunk_id", F.substring("content", 1, preview).alias("content_preview")).dropDuplicates(["chunk_id"])
    return own.withColumn("verdict", verdict).join(c, "chunk_id", "left").select("id", "role", "kind", "chunk_id", "document_path", "line_number", F.coalesce("content_preview", F.lit("")).alias("content_preview"), "verdict")


def with_dynamic(symbols: DataFrame, registered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, errors): runtime symbols (agent_id, name, kind, role, document_path, line_number) join the others under runtime:<agent>:<name>.

    A symbol registered again replaces itself; one without a name or with another role is an error.
    """
    ok = F.coalesce((F.col("name") != "") & F.col("role").isin("definition", "reference"), F.lit(False))
    chunk = F.concat(F.lit("runtime:"), "agent_id", F.lit(":"), "name")
    new = registered.where(ok).select("name", F.coalesce("kind", F.lit("function")).alias("kind"), "role", chunk.alias("chunk_id"), "document_path", F.col("line_number").cast("long").alias("line_number"), F.lit(None).cast("string").alias("container"))
    new = new.dropDuplicates(["chunk_id", "role"]).withColumn("id", -F.abs(F.xxhash64("chunk_id", "role")))
    kept = symbols.join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in symbols.columns])), registered.where(~ok)


def dynamic(symbols: DataFrame, agent: str | None = None) -> DataFrame:
    """The runtime symbols, of all agents or of one."""
    return symbols.where(F.startswith("chunk_id", F.lit("runtime:" if agent is None else f"runtime:{agent}:")))


def without_dynamic(symbols: DataFrame, agent: str) -> DataFrame:
    return symbols.where(~F.coalesce(F.startswith("chunk_id", F.lit(f"runtime:{agent}:")), F.lit(False)))


def impact_files(reached: DataFrame, chunk_paths: DataFrame, path_part: str | None = None) -> DataFrame:
    """(path, chunks, depth_min, depth_max) of what a walk reached beyond its seeds; runtime chunks are walked but not told."""
    paths = chunk_paths if path_part is None else chunk_paths.where(F.contains("document_path", F.lit(path_part)))
    met = reached.where("hop > 0").where(~F.startswith("chunk_id", F.lit("runtime:"))).join(paths.select("chunk_id", "document_path"), "chunk_id")
    return met.groupBy(F.col("document_path").alias("path")).agg(F.count("*").alias("chunks"), F.min("hop").alias("depth_min"), F.max("hop").alias("depth_max"))


def test_edges(symbols: DataFrame) -> DataFrame:
    """Edges from the first chunk of a test file to that of the file it tests, by file names (test_x, x_test, tests/x)."""
    s = cleaned(symbols).groupBy("document_path").agg(F.min_by("chunk_id", "id").alias("chunk"))
    name = F.regexp_extract("document_path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    folder = F.concat(F.lit("/"), F.col("document_path")).rlike(r"/tests?/")
    d = s.withColumns({"stem": stem, "folder": folder}).withColumn("test", F.col("folder") | F.startswith("stem", F.lit("test_")) | F.endswith("stem", F.lit("_test")))
    keys = F.array_compact(
        F.array(
            F.when(F.startswith("stem", F.lit("test_")), F.substring("stem", 6, 10_000)),
            F.when(F.endswith("stem", F.lit("_test")), F.regexp_replace("stem", "_test$", "")),
            F.when(F.col("folder"), F.col("stem")),
        )
    )
    tests = d.where("test").select(F.col("chunk").alias("source_chunk_id"), F.explode(keys).alias("stem"))
    sources = d.where("NOT test").select("stem", F.col("chunk").alias("target_chunk_id"))
    return tests.join(sources, "stem").select("source_chunk_id", "target_chunk_id").distinct().withColumns({"edge_type": F.lit("test_of"), "symbol_name": F.lit("test")})


def file_dependencies(symbols: DataFrame) -> DataFrame:
    """(source_path, target_path): the first file, by path, that each imported module may mean."""
    s = cleaned(symbols)
    modules = s.where((F.col("role") == "reference") & (F.col("kind") == "module")).select("document_path", F.col("name").alias("module")).distinct()
    paths = s.where(F.col("role") == "definition").select(F.col("document_path").alias("path")).distinct()
    met = modules.join(module_matches(modules.select("module").distinct(), paths), "module")
    return met.groupBy("document_path", "module").agg(F.min("path").alias("target_path")).select(F.col("document_path").alias("source_path"), "target_path").distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int, forward: bool = False) -> DataFrame:
    """(chunk_id, hop): the least number of edges from the seeds, up to ``depth``; seeds have 0.

    One join a hop; what was reached before is left out, and each hop's frontier is written, so the plan does not grow
    with the depth and a lost executor costs one hop.
    """
    a, b = ("source_chunk_id", "target_chunk_id") if forward else ("target_chunk_id", "source_chunk_id")
    pairs = edges.select(F.col(a).alias("at"), F.col(b).alias("to")).distinct()
    seen = seeds.select("chunk_id").distinct().withColumn("hop", F.lit(0).cast("long"))
    front = seen.select("chunk_id")
    for hop in range(1, depth + 1):
        found = front.join(pairs, F.col("chunk_id") == F.col("at")).select(F.col("to").alias("chunk_id")).distinct().join(seen, "chunk_id", "left_anti")
        front = materialize(found, "reach")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop).cast("long")))
        if front.isEmpty():
            break
    return seen


def staleness(edges: DataFrame, changed: DataFrame, decay: float = 0.8, max_depth: int = 3) -> DataFrame:
    """(chunk_id, staleness): decay to the power of the hop, hop 1 to max_depth + 1, for what depends on the changed chunks; these have 0."""
    return reach(edges, changed, max_depth + 1).select("chunk_id", F.when(F.col("hop") == 0, 0.0).otherwise(F.pow(F.lit(decay), F.col("hop"))).alias("staleness"))


def definition_files(symbols: DataFrame) -> DataFrame:
    """(name, files): in how many files each name is defined."""
    return cleaned(symbols).where(F.col("role") == "definition").groupBy("name").agg(F.count_distinct("document_path").alias("files"))


def name_weight(files: Column, name: Column, noise: list[str]) -> Column:
    """1 for a name defined in one file, less the more files define it; 0 for noise and short names."""
    return F.when(name.isin(noise) | (F.char_length(name) <= 3), 0.0).otherwise(1 / (1 + F.log2(F.greatest(F.coalesce(files, F.lit(1)), F.lit(1)).cast("double"))))


def _weighted(pairs: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """(key, names, weight) from distinct (key, name)."""
    w = pairs.select(key, "name").distinct().join(files, "name", "left")
    return w.groupBy(key).agg(F.count("*").alias("names"), F.round(F.sum(name_weight(F.col("files"), F.col("name"), NOISE)), 2).alias("weight"))


def coupling(edges: DataFrame, chunk_paths: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """(path, direction, edges, names, weight): the files that share edges with one file."""
    # the file's own chunks first: only edges at them meet the paths
    own = materialize(chunk_paths.where(F.col("document_path") == path).select("chunk_id").distinct(), "own")
    touching = edges.join(own.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_semi").unionByName(edges.join(own.withColumnRenamed("chunk_id", "target_chunk_id"), "target_chunk_id", "left_semi")).distinct()
    src = chunk_paths.select(F.col("chunk_id").alias("source_chunk_id"), F.col("document_path").alias("sp"))
    dst = chunk_paths.select(F.col("chunk_id").alias("target_chunk_id"), F.col("document_path").alias("tp"))
    e = touching.join(src, "source_chunk_id").join(dst, "target_chunk_id").where(F.col("sp") != F.col("tp"))
    e = e.select(F.when(F.col("sp") == path, F.col("tp")).otherwise(F.col("sp")).alias("path"), (F.col("sp") == path).alias("out"), F.col("symbol_name").alias("name"))
    direction = F.when(F.min("out") != F.max("out"), "bidirectional").when(F.max("out"), "depends_on").otherwise("depended_on_by")
    totals = e.groupBy("path").agg(direction.alias("direction"), F.count("*").alias("edges"))
    return totals.join(_weighted(e, "path", definition_files(symbols)), "path")


def co_consumers(edges: DataFrame, chunk_paths: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """(path, consumers, names, score): the files that the same chunks refer to as refer to one file."""
    dst = chunk_paths.select(F.col("chunk_id").alias("target_chunk_id"), F.col("document_path").alias("tp"))
    src = chunk_paths.select(F.col("chunk_id").alias("source_chunk_id"), F.col("document_path").alias("sp"))
    e = edges.join(dst, "target_chunk_id")
    users = e.where(F.col("tp") == path).select("source_chunk_id").distinct()
    other = e.where(F.col("tp") != path).join(users, "source_chunk_id", "left_semi").join(src, "source_chunk_id").select(F.col("tp").alias("path"), "sp", F.col("symbol_name").alias("name"))
    shared = other.groupBy("path").agg(F.count_distinct("sp").alias("consumers"))
    return shared.join(_weighted(other, "path", definition_files(symbols)), "path").select("path", "consumers", "names", F.round(F.col("weight") + F.round(F.col("consumers") * 0.5, 2), 2).alias("score"))
