"""A facade over the operators for one set of tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.functions import query as Q
from quillgraph.functions import text as T
from quillgraph.operators import answers, bm25, chunkers, compose, extraction, features, grep, store, vectors
from quillgraph.operators import symbols as S
from quillgraph.session import materialize
from quillgraph.sources.files import files, texts


class Engine:
    """Chunks, symbols and vectors of a corpus, and the questions asked of them.

    ``chunks`` has chunk_id, document_path, content, start_pos, end_pos, token_count; ``symbols`` and ``signatures``
    (chunk_id, signature) follow from it unless given.  Indexes are built on first use and kept as written tables.
    """

    def __init__(self, chunks: DataFrame, symbols: DataFrame | None = None, signatures: DataFrame | None = None, config: EngineConfig | None = None):
        self.config = config or EngineConfig()
        self.chunks = chunks
        self._symbols, self._signatures, self._given = symbols, signatures, None
        self._made: dict[str, Any] = {}

    @classmethod
    def from_folder(cls, spark: SparkSession, root: str, config: EngineConfig | None = None) -> Engine:
        """The corpus of a folder: code is cut at definitions, other texts at paragraphs."""
        conf = config or EngineConfig()
        docs = texts(files(spark, root, skipped=list(conf.skip_dirs) or None))
        code = chunkers.code(docs.where("modality = 'code'"), "path", "text", "path", conf.chunk_size)
        prose = chunkers.paragraphs(docs.where("modality = 'text'"), "path", "text", conf.chunk_size, conf.max_chunk_size)
        c = code.unionByName(prose).withColumnRenamed("doc", "document_path")
        made = c.select(
            T.chunk_id("document_path", "start_pos", "end_pos", "content").alias("chunk_id"), "document_path", "content", "start_pos", "end_pos", T.estimated_tokens("content").alias("token_count")
        )
        return cls(materialize(made, "chunks"), config=conf)

    def _once(self, name: str, make: Any) -> Any:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def index(self) -> bm25.Index:
        return self._once("index", lambda: bm25.Index(self.chunks, "chunk_id", "content"))

    @property
    def symbols(self) -> DataFrame:
        if self._symbols is not None:
            return self._symbols

        def make() -> DataFrame:
            s = extraction.extract(self.chunks, "chunk_id", "content", "document_path").withColumnRenamed("doc", "chunk_id")
            s = s.join(self.chunks.select("chunk_id", "document_path"), "chunk_id")
            return materialize(s.withColumn("id", F.xxhash64(*s.columns)), "symbols")

        return self._once("symbols", make)

    @property
    def signatures(self) -> DataFrame:
        return self._signatures if self._signatures is not None else self._once("signatures", lambda: materialize(features.fingerprints(self.chunks, "chunk_id", "content"), "signatures"))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: materialize(S.resolve(self.symbols), "edges"))

    def search(self, query: str, top_k: int = 10, mode: str = "keyword", path_prefix: str | None = None, max_tokens: int | None = None, compact: bool = False) -> DataFrame:
        """(chunk_id, score, source, document_path, content or its preview): ranked chunks.

        Keyword search, or the blend with vectors (mode 'hybrid'); an unknown mode is keyword.  Chunks that define a name of
        the query and are not ranked join at the end, then the closeness of the query's words counts.  A path is kept to
        before the cut; with ``max_tokens`` the list ends before the first result that would exceed it.
        """
        scores = self.index.scores(query)
        chunks = self.chunks if path_prefix is None else self.chunks.where(T.under_path("document_path", path_prefix))
        if path_prefix:
            scores = scores.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        if mode.strip().lower() != "hybrid":
            hits = bm25.top(scores, 2 * top_k)
            best = hits.agg(F.max("score")).scalar()
            ranked = hits.select("id", (F.col("score") / best).alias("score"), F.lit("keyword").alias("source"))
        else:
            near = vectors.nearest(self.effective(chunks), "chunk_id", "signature", features.fingerprint(query).tolist(), 3 * top_k)
            ranked = vectors.hybrid(near, bm25.top(scores, 2 * top_k), vectors.blend_weight(query, self.config.search_alpha), 2 * top_k, self.given_ids())
        ranked = ranked.select(F.col("id").alias("chunk_id"), "score", "source")
        names = Q.identifiers(query)
        if names:
            extra = compose.symbol_boost(ranked, S.cleaned(self.symbols), names, chunks).select("chunk_id", "score", F.lit("symbol").alias("source"))
            some = ranked.limit(1).select(F.lit(1).alias("_any"))  # nothing ranked: nothing is added
            ranked = ranked.unionByName(extra.withColumn("_any", F.lit(1)).join(some, "_any").drop("_any"))
        texts = chunks.select("chunk_id", "document_path", "content")
        rows = ranked.join(texts, "chunk_id").withColumn("id", F.col("chunk_id"))
        terms = Q.proximity_terms(query)
        if terms:
            closer = compose.rerank(rows, "content", terms, top_k).select(F.col("id").alias("chunk_id"), "score")
            rows = rows.drop("score", "id").join(closer, "chunk_id")
        out = rows.select("chunk_id", "score", "source", "document_path", "content").orderBy(F.desc("score"), "chunk_id").limit(top_k)
        return answers.within_tokens(out, [F.desc("score"), F.col("chunk_id")], max_tokens, compact) if compact or max_tokens is not None else out

    def give_vectors(self, given: DataFrame) -> DataFrame:
        """Take agents' vectors (chunk_id, v) in place of the chunks' own; returns those that are refused, with the reason."""
        own = self.signatures.select("chunk_id", F.col("signature").alias("v"))
        self._given = given
        return vectors.refused(own, given, features.DIM)

    def given_ids(self) -> DataFrame | None:
        return None if self._given is None else self._given.select(F.col("chunk_id").alias("id"))

    def effective(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, signature) of the chunks as searched."""
        own = self.signatures.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        if self._given is None:
            return own
        return vectors.with_given(own.select("chunk_id", F.col("signature").alias("v")), self._given, features.DIM).select("chunk_id", F.col("v").alias("signature"))

    def search_text(self, pattern: str, regex: bool = False, path: str | None = None) -> DataFrame:
        return grep.matching_chunks(self.chunks if path is None else self.chunks.where(F.col("document_path") == path), pattern, regex)

    def agent_grep(self, pattern: str, regex: bool = False, path: str | None = None, group_by: str = "file", max_tokens: int = 4000, deduplicate: bool = True, context: int = 0) -> tuple[DataFrame, DataFrame]:
        """(groups, summary) of the matches, each with its line in the file, role and enclosing scope; see ``operators.answers``."""
        chunks = self.chunks if path is None else self.chunks.where(F.col("document_path") == path)
        matches = materialize(answers.entries(chunks, S.cleaned(self.symbols), pattern, regex, context), "grep")
        groups = answers.grouped(matches, group_by, max_tokens, deduplicate)
        return groups.where("shown"), answers.summary(groups, matches)

    def find_definition(self, name: str) -> DataFrame:
        """Every definition of a name, with its place among those of the same file."""
        own = S.cleaned(self.symbols).where((F.col("role") == "definition") & (F.col("name") == name))
        w = Window.partitionBy("document_path")
        return own.withColumns({"shadow_index": F.row_number().over(w.orderBy(F.col("line_number").asc_nulls_first(), "id")).cast("long"), "shadow_count": F.count("*").over(w)})

    def find_references(self, name: str) -> DataFrame:
        return S.references_of(self.symbols, self.chunks, name)

    def impact_radius(self, document_path: str | None = None, depth: int = 2, symbol: str | None = None, chunk_id: str | None = None, direction: str = "dependents", significance: float = 0.0, excluded: list[str] | None = None) -> DataFrame:
        """(chunk_id, hop) of what depends on a file, a symbol's definitions or a chunk (or what they depend on: 'dependencies')."""
        if chunk_id:
            seeds = self.chunks.where(F.col("chunk_id") == chunk_id)
        elif symbol:
            seeds = S.cleaned(self.symbols).where((F.col("role") == "definition") & (F.col("name") == symbol))
        elif document_path:
            seeds = self.chunks.where(F.col("document_path") == document_path)
        else:
            raise ValueError("a chunk, a symbol or a file must be given")
        edges = self.edges.where(S.significant(F.col("symbol_name"), significance, excluded))
        return S.reach(edges, seeds.select("chunk_id"), depth, forward=direction == "dependencies")

    def impact_files(self, document_path: str, depth: int = 2, path_part: str | None = None, top: int | None = None) -> DataFrame:
        """(path, chunks, depth_min, depth_max), those with most chunks first."""
        files = S.impact_files(self.impact_radius(document_path, depth), self.chunks, path_part).orderBy(F.desc("chunks"), "path")
        return files if top is None else files.limit(max(1, top))

    def coupling(self, document_path: str, mode: str = "edges") -> DataFrame:
        op = S.co_consumers if mode == "co_consumers" else S.coupling
        return op(self.edges, self.chunks.select("chunk_id", "document_path"), self.symbols, document_path)

    def staleness(self, changed: DataFrame) -> DataFrame:
        return S.staleness(self.edges, changed)

    def project_map(self) -> DataFrame:
        return self.chunks.groupBy("document_path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))

    def detect_changes(self, seen: DataFrame, stored: DataFrame) -> DataFrame:
        return store.snapshot_diff(stored, seen, "path", "hash")

    def answer(self, query: str, top_k: int = 20) -> DataFrame:
        """(chunk_id, source): the query's ranked chunks, then chunks with its first three names (definitions first), then chunks that hold it as it stands; each once."""
        hits = bm25.top(self.index.scores(query), top_k)
        ranked = hits.select(F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("pos"))  # top_k rows
        order = F.struct((F.col("role") != "definition").alias("a"), F.col("id").alias("b"))
        named = S.cleaned(self.symbols).where(F.col("name").isin(Q.identifiers(query)[:3])).groupBy("chunk_id").agg(F.min(order).alias("o"))
        named = named.orderBy("o").limit(top_k).select("chunk_id", F.row_number().over(Window.orderBy("o")).cast("long").alias("pos")) if Q.identifiers(query) else ranked.where("false")
        literal = self.search_text(query).select("chunk_id", F.col("start_pos").cast("long").alias("pos"))
        return compose.first_sources([("semantic", ranked), ("symbol", named), ("text", literal)], top_k)

    def batch(self, calls: list[tuple[str, dict[str, Any]]]) -> list[DataFrame]:
        """The answers of several calls by method name; a name that is none raises before anything runs."""
        methods = [getattr(self, name) for name, _ in calls if not name.startswith("_")]
        if len(methods) != len(calls):
            raise ValueError("private methods can't be called")
        return [m(**args) for m, (_, args) in zip(methods, calls, strict=True)]
