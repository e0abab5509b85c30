"""Named queries of the core; each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import calls, corpus, decisions, extract, graph, metrics, mining, overview, parse, references, review, rules, semantic, verification
from corpusloom.plans import project
from corpusloom.session import durable, release
from corpusloom.sources import diffs
from corpusloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Start of the change that the review queries look at.
CHANGE = "2026-05-01"
EXCLUDE = ["node_modules/**", "**/node_modules/**", "vendor/**", "dist/**", "build/**", "**/*.min.js"]
ALIASES = {"@/": "src"}


class Corpus:
    """The tables of a folder and the live views of them, each built when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def files(self, *columns: str) -> DataFrame:
        return corpus.live_files(self.raw("files"), *columns)

    def symbols(self) -> DataFrame:
        return corpus.live_symbols(self.raw("symbols"))

    def imports(self) -> DataFrame:
        return corpus.live_imports(self.raw("imports"))

    def edges(self) -> DataFrame:
        return graph.import_edges(self.imports(), self.files())

    def nodes(self) -> DataFrame:
        return graph.file_nodes(self.edges(), self.files())

    def layers(self) -> DataFrame:
        return graph.file_layers(self.files(), self.imports(), self.symbols())

    def calls(self) -> DataFrame:
        return self.raw("calls").distinct()

    def call_edges(self) -> DataFrame:
        return calls.call_edges(self.calls(), calls.symbol_nodes(self.symbols()), self.imports())

    def metrics(self) -> DataFrame:
        return calls.fan_in_out(calls.symbol_nodes(self.symbols()), self.call_edges())

    def tokens(self) -> DataFrame:
        return semantic.file_tokens(self.files(), self.symbols(), self.imports())

    def weights(self) -> DataFrame:
        return semantic.tfidf(durable(self.tokens()), self.files())

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """The vectors of the files, and their connected parts at a cosine of 0.3."""
        vectors, links = self.links([0.3])
        parts = semantic.clusters_at(links, vectors.select("repo", "path", "same"), 0.3)
        release(links)
        return vectors, parts

    def links(self, limits: list[float]) -> tuple[DataFrame, DataFrame]:
        terms = semantic.file_terms(self.files(), corpus.symbol_rows(self.raw("symbols")), corpus.import_rows(self.raw("imports")))
        vectors, counts = semantic.file_vectors(terms, self.files())
        return vectors, durable(semantic.similar_links(vectors, counts, limits))

    def scores(self) -> DataFrame:
        return verification.claim_scores(verification.claims(self.raw("rules")), self.files("content"), self.symbols(), self.imports())

    def results(self) -> DataFrame:
        return verification.rule_results(self.scores())

    def patterns(self) -> DataFrame:
        return mining.mine_patterns(self.files("content"), self.symbols(), self.imports())


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register a query under its function's name."""
    QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
    return f


@query
def p3_found(c: Corpus) -> DataFrame:
    """References with no target alive at their own time."""
    return references.orphan_references(*(c.raw(n) for n in ("imports", "calls", "rules", "files", "symbols"))).select("ref_table", "ref_id", "ref_pos")


@query
def p3_counts(c: Corpus) -> DataFrame:
    """Orphan references by table and month."""
    return references.orphan_counts(references.orphan_references(*(c.raw(n) for n in ("imports", "calls", "rules", "files", "symbols"))))


@query
def language_breakdown(c: Corpus) -> DataFrame:
    """Live files by repository and language."""
    return corpus.language_breakdown(c.raw("files"))


@query
def top_directories(c: Corpus) -> DataFrame:
    """The largest directories of each repository with their main language."""
    return corpus.top_directories(c.raw("files"))


@query
def content_copies(c: Corpus) -> DataFrame:
    """Contents that stand in several live files."""
    return corpus.content_copies(c.raw("files"))


@query
def incremental_scan(c: Corpus) -> DataFrame:
    """Files to reuse and to parse again since the start of 2026."""
    return corpus.incremental_scan(c.raw("files"))


@query
def scannable_files(c: Corpus) -> DataFrame:
    """Live source files that a scan keeps."""
    return corpus.scannable_files(c.raw("files"), EXCLUDE)


@query
def corpus_totals(c: Corpus) -> DataFrame:
    """Live files, symbols and imports of each repository."""
    return corpus.totals(c.raw("files"), c.raw("symbols"), c.raw("imports"))


@query
def line_imports(c: Corpus) -> DataFrame:
    """Imports read from source lines, by language and kind."""
    files = c.files("content")
    return extract.line_imports(files).join(files.select("file_id", "language"), "file_id").groupBy("language", "kind").agg(F.count(F.lit(1)).alias("imports"), F.count_distinct("source").alias("sources"))


@query
def line_symbols(c: Corpus) -> DataFrame:
    """Symbols read from source lines."""
    return extract.line_symbols(c.files("content"))


@query
def line_exports(c: Corpus) -> DataFrame:
    """Exports read from the lines of scripts."""
    return extract.line_exports(c.files("content"))


@query
def marker_comments(c: Corpus) -> DataFrame:
    """Comments that begin with a marker word."""
    return extract.marker_comments(c.files("content")).select("file_id", "line", "marker")


@query
def parsed_symbols(c: Corpus) -> DataFrame:
    """Declarations with their spans, read from contents."""
    return parse.parsed_symbols(c.files("content"))


@query
def parsed_calls(c: Corpus) -> DataFrame:
    """Call sites read from contents."""
    return parse.parsed_calls(c.files("content"))


@query
def resolved_imports(c: Corpus) -> DataFrame:
    """Relative and aliased imports resolved by candidate paths."""
    return graph.resolve_imports(c.imports(), c.files(), ALIASES)


@query
def import_edges(c: Corpus) -> DataFrame:
    """Distinct import edges between live files."""
    return c.edges()


@query
def degree_betweenness(c: Corpus) -> DataFrame:
    """Degrees and the in-times-out centrality of each live file."""
    return c.nodes()


@query
def hub_files(c: Corpus) -> DataFrame:
    """Files of at least eight edges."""
    return graph.hub_files(c.nodes()).select("repo", "path", "degree")


@query
def architecture_top10(c: Corpus) -> DataFrame:
    """The ten files of highest degree of each repository."""
    return graph.top_nodes(c.nodes()).select("repo", "rank", "path", "degree")


@query
def file_layers(c: Corpus) -> DataFrame:
    """The architectural layer of each live file."""
    return c.layers()


@query
def layer_boundaries(c: Corpus) -> DataFrame:
    """Edges and violations between layers."""
    return graph.layer_boundaries(c.edges(), c.layers())


@query
def boundary_rules(c: Corpus) -> DataFrame:
    """An import constraint for each violated boundary."""
    return rules.boundary_rules(graph.layer_boundaries(c.edges(), c.layers()))


@query
def files_on_cycles(c: Corpus) -> DataFrame:
    """Files on an import cycle."""
    return graph.files_on_cycles(c.edges())


@query
def dependencies(c: Corpus) -> DataFrame:
    """Both directions of each file's edges."""
    return graph.dependencies(c.edges(), c.nodes(), c.layers())


@query
def call_edges(c: Corpus) -> DataFrame:
    """One edge for each call site, resolved where its target is known."""
    return c.call_edges()


@query
def fan_in_out(c: Corpus) -> DataFrame:
    """Fan-in and fan-out of each symbol."""
    return c.metrics().select("repo", "path", "name", "kind", "fan_in", "fan_out")


@query
def hotspots(c: Corpus) -> DataFrame:
    """Functions and methods of at least three callers."""
    return calls.hotspots(c.metrics(), 3)


@query
def callgraph_top10(c: Corpus) -> DataFrame:
    """The ten most called symbols of each repository."""
    return calls.top_callees(c.metrics())


@query
def god_classes(c: Corpus) -> DataFrame:
    """Classes of at least five methods or five callers."""
    return calls.god_classes(c.metrics(), 5, 5)


@query
def p90_length(c: Corpus) -> DataFrame:
    """The length that nine of ten functions do not exceed."""
    return calls.length_p90(c.symbols())


@query
def call_depth(c: Corpus) -> DataFrame:
    """Symbols on the longest chain of resolved calls of each repository."""
    return calls.call_depth(c.call_edges())


@query
def identifier_terms(c: Corpus) -> DataFrame:
    """Words of each live file's identifiers."""
    return c.tokens()


@query
def vocabulary(c: Corpus) -> DataFrame:
    """Terms by document frequency."""
    return semantic.vocabulary(c.tokens())


@query
def tfidf_weights(c: Corpus) -> DataFrame:
    """Term weights to four digits."""
    return c.weights().select("repo", "path", "term", (F.floor(F.col("weight") * 10000 + 0.5) / 10000).alias("weight"))


@query
def cosine_pairs(c: Corpus) -> DataFrame:
    """Pairs of files of a cosine of at least 0.3, between files that stand for all of the same terms."""
    return semantic.similar_pairs(durable(c.weights()), 0.3).select("repo", "a", "b", (F.floor(F.col("cosine") * 1000 + 0.5) / 1000).alias("cosine"))


@query
def similar_files(c: Corpus) -> DataFrame:
    """The five files most similar to each whose id is divisible by 100."""
    weights = durable(c.weights())
    asked = c.files().filter("file_id % 100 = 0").select("repo", "path")
    return semantic.similar_files(weights, weights.join(asked, ["repo", "path"], "left_semi").withColumnRenamed("path", "query"))


@query
def rule_similar_files(c: Corpus) -> DataFrame:
    """The three files most similar to the words of each rule's verification pattern and id."""
    from corpusloom.functions.identifiers import split_identifier

    text = F.concat_ws(" ", "id", "verification.pattern", "verification.source", "verification.forbidden")
    words = rules.distinct_rules(c.raw("rules")).select("repo", F.col("rule_no").alias("query"), F.explode(split_identifier(text)).alias("term"))
    asked = semantic.query_vectors(words.groupBy("repo", "query", "term").agg(F.count(F.lit(1)).alias("tf")))
    return semantic.similar_files(c.weights(), asked.withColumn("query", F.col("query").cast("string")), 3)


@query
def clusters_at_threshold(c: Corpus) -> DataFrame:
    """Connected parts of files at a cosine of 0.3."""
    vectors, parts = c.parts()
    release(vectors)
    return parts


@query
def adaptive_clusters(c: Corpus) -> DataFrame:
    """Connected parts at the cosine limit that suits each repository."""
    vectors, links = c.links(semantic.LIMITS)
    return semantic.adaptive_clusters(links, vectors.select("repo", "path", "same"), c.files())


@query
def cluster_terms(c: Corpus) -> DataFrame:
    """The leading terms of each part at a cosine of 0.3."""
    vectors, parts = c.parts()
    return semantic.cluster_terms(parts, vectors)


@query
def cluster_cohesion(c: Corpus) -> DataFrame:
    """The mean cosine within each part at a cosine of 0.3."""
    vectors, parts = c.parts()
    return semantic.cohesion(parts, vectors)


@query
def cluster_imports(c: Corpus) -> DataFrame:
    """Imports shared by a fifth of the members of each directory of at least four files."""
    from corpusloom.functions.paths import dirname

    groups = c.files().select("repo", "path", dirname(F.col("path")).alias("component"))
    return mining.shared_cluster_imports(groups, c.imports(), 4, 0.2)


@query
def mined_patterns(c: Corpus) -> DataFrame:
    """Conventions that each repository follows."""
    return c.patterns()


@query
def pattern_checks(c: Corpus) -> DataFrame:
    """What verifies each mined convention."""
    return rules.pattern_checks(c.patterns())


@query
def claims(c: Corpus) -> DataFrame:
    """One claim for each rule."""
    return verification.claims(c.raw("rules")).select("rule_no", "repo", "type", "assertion", "threshold", "applies_to", "subject")


@query
def claim_scores(c: Corpus) -> DataFrame:
    """Scores of all claims against the live corpus."""
    return c.scores().select("rule_no", "type", "matched", "checked", "score")


@query
def rule_status(c: Corpus) -> DataFrame:
    """Status of each rule."""
    return c.results()


@query
def context_health(c: Corpus) -> DataFrame:
    """Health of each repository's rules."""
    return verification.health(c.results())


@query
def quick_verify(c: Corpus) -> DataFrame:
    """Health over the critical rules alone."""
    critical = c.raw("rules").filter("severity = 'critical'")
    scores = verification.claim_scores(verification.claims(critical), c.files("content"), c.symbols(), c.imports())
    return verification.health(verification.rule_results(scores))


@query
def rule_projection(c: Corpus) -> DataFrame:
    """Rules as the query interface shows them."""
    return rules.distinct_rules(c.raw("rules")).select("rule_no", "repo", "id", "category", "severity", "priority", rules.description(F.col("enhanced"), F.col("description")).alias("description"))


@query
def rules_to_enhance(c: Corpus) -> DataFrame:
    """Rules without a fresh enhancement."""
    return rules.needing_enhancement(c.raw("rules")).select("rule_no", "repo", "id")


@query
def prompt_batches(c: Corpus) -> DataFrame:
    """Rules to enhance in batches of ten."""
    return rules.prompt_batches(c.raw("rules"))


@query
def category_summary(c: Corpus) -> DataFrame:
    """Rules and evidence by category."""
    return rules.category_summary(c.raw("rules"))


@query
def rules_markdown(c: Corpus) -> DataFrame:
    """Each repository's rules as one text."""
    return rules.markdown(c.raw("rules"))


def _change(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges before the change, new edges, nodes before it)."""
    seen = c.imports()
    before = graph.import_edges(seen.filter(F.col("scanned_at") < F.lit(CHANGE).cast("timestamp")), c.files())
    layers = c.layers()
    fresh = review.new_edges(before, c.edges(), layers, graph.layer_boundaries(before, layers))
    return before, fresh, graph.file_nodes(before, c.files())


@query
def new_edges(c: Corpus) -> DataFrame:
    """Edges first seen since the change, with the boundaries and cycles that they break."""
    return _change(c)[1]


@query
def complexity_changes(c: Corpus) -> DataFrame:
    """How the change raises degrees."""
    _, fresh, nodes = _change(c)
    return review.complexity_changes(fresh, nodes)


@query
def rule_hits(c: Corpus) -> DataFrame:
    """New edges that a rule forbids."""
    return review.rule_hits(_change(c)[1], c.raw("rules"))


@query
def review_summary(c: Corpus) -> DataFrame:
    """Violations of the change by repository."""
    _, fresh, nodes = _change(c)
    fresh = durable(fresh)
    found = review.violations(fresh, review.complexity_changes(fresh, nodes), review.rule_hits(fresh, c.raw("rules")))
    return review.summary(found, fresh.select("repo", F.col("source").alias("path")))


@query
def similar_suggestions(c: Corpus) -> DataFrame:
    """The file most similar to each that was first scanned since the change, from a cosine of 0.1."""
    weights = durable(c.weights())
    asked = c.files("scanned_at").filter(F.col("scanned_at") >= F.lit(CHANGE).cast("timestamp")).select("repo", "path")
    similar = semantic.similar_files(weights, weights.join(asked, ["repo", "path"], "left_semi").withColumnRenamed("path", "query"), 1)
    return review.similar_suggestions(similar, 0.1)


@query
def pattern_adoption(c: Corpus) -> DataFrame:
    """Files that use ``async`` by month of their scan."""
    return metrics.pattern_adoption(c.files("content", "scanned_at"), "async ")


@query
def diff_files(c: Corpus) -> DataFrame:
    """Every live file as the diff that adds it, parsed back."""
    return diffs.diff_files(diffs.added_file_diffs(c.files("content")), "repo", "path")


def _decisions(c: Corpus) -> tuple[DataFrame, DataFrame]:
    documents = c.raw("documents")
    columns = ["id", "repo", "title", "decided_at", "kind"]
    return decisions.record_decisions(documents).select(*columns), decisions.commit_decisions(documents).select(*columns)


@query
def commit_decisions(c: Corpus) -> DataFrame:
    """Commit documents that tell a decision."""
    return decisions.commit_decisions(c.raw("documents"))


@query
def record_decisions(c: Corpus) -> DataFrame:
    """Decision records with title and status."""
    return decisions.record_decisions(c.raw("documents")).select("id", "repo", "title", "status")


@query
def comment_decisions(c: Corpus) -> DataFrame:
    """Decision comments in files that rules cite."""
    return decisions.comment_decisions(rules.distinct_rules(c.raw("rules")), c.files("content"))


@query
def decision_merge(c: Corpus) -> DataFrame:
    """Decision records with the commit decisions under new ids."""
    return decisions.merged(*_decisions(c))


@query
def decision_rules(c: Corpus) -> DataFrame:
    """Rules that decisions touch."""
    return decisions.linked_rules(decisions.merged(*_decisions(c)), c.raw("rules"))


@query
def decision_timeline(c: Corpus) -> DataFrame:
    """Decisions by repository and month."""
    return decisions.timeline(decisions.merged(*_decisions(c)))


@query
def frameworks(c: Corpus) -> DataFrame:
    """The framework that each repository's imports name."""
    return overview.frameworks(c.imports())


@query
def entry_points(c: Corpus) -> DataFrame:
    """Files where programs start."""
    return overview.entry_points(c.files())


@query
def external_packages(c: Corpus) -> DataFrame:
    """Packages from outside by the files that import them."""
    return overview.external_packages(c.imports())


@query
def snapshot_retention(c: Corpus) -> DataFrame:
    """The last fifty events of each user."""
    return metrics.retained(c.raw("events"), "user_id", "ts", "event_id").select("event_id", "user_id", "ts")


@query
def project_summary(c: Corpus) -> DataFrame:
    """Files, symbols, imports, exports, edges, boundaries and patterns of each repository, read from its contents alone."""
    return project.summary(project.analyze(c.files("content").select("repo", "path", "content"), EXCLUDE))


@query
def import_names(c: Corpus) -> DataFrame:
    """Imports of source lines with the names that they bring in."""
    return extract.import_names(c.files("content")).select("file_id", "line", "source", "names", "is_default", "is_namespace")


@query
def exported_names(c: Corpus) -> DataFrame:
    """What each file exports, in any language."""
    return extract.exported_names(c.files("content")).select("file_id", "line", "type", "name")


@query
def full_terms(c: Corpus) -> DataFrame:
    """Words of each live file's identifiers, exports and marker comments."""
    files = c.files("content")
    names = durable(extract.exported_names(files).select("repo", "path", "name"))
    return semantic.file_tokens(c.files(), c.symbols(), c.imports(), names, extract.marker_comments(files))


@query
def resolved_edges(c: Corpus) -> DataFrame:
    """Import edges, those without a resolved path by the resolver."""
    return graph.resolved_edges(c.imports(), c.files(), c.files("content"))


@query
def same_terms(c: Corpus) -> DataFrame:
    """The file that stands for each in the pairs: the first with the same weights."""
    return semantic.same_terms(c.weights())


@query
def structural_clusters(c: Corpus) -> DataFrame:
    """Parts of similar files that share an import or hold together."""
    vectors, parts = c.parts()
    together = durable(semantic.cohesion(parts, vectors))
    release(vectors)
    return mining.structural_clusters(parts, corpus.import_rows(c.raw("imports")), together, c.files())


@query
def naming_examples(c: Corpus) -> DataFrame:
    """Names that follow a naming style, and names that do not."""
    return mining.naming_examples(c.symbols())


@query
def hub_rules(c: Corpus) -> DataFrame:
    """The three files of most edges of each repository, of at least eight."""
    return graph.top_nodes(graph.hub_files(c.nodes()), 3).select("repo", "rank", "path", "degree")


@query
def hotspot_rules(c: Corpus) -> DataFrame:
    """The three functions of most callers of each repository, of at least three."""
    return calls.top_callees(calls.hotspots(c.metrics(), 3), 3)


@query
def rule_details(c: Corpus) -> DataFrame:
    """Each rule with its status, score and first evidence."""
    return rules.rule_details(c.raw("rules"), c.results())


@query
def rules_to_mend(c: Corpus) -> DataFrame:
    """Rules that are not valid."""
    return c.results().filter("status <> 'valid'")


@query
def model_files(c: Corpus) -> DataFrame:
    """For each new edge that breaks a boundary or closes a cycle, a file to look at."""
    _, fresh, nodes = _change(c)
    return review.model_files(fresh, nodes, c.layers())


@query
def metric_trend(c: Corpus) -> DataFrame:
    """Daily means of event values by type."""
    rows = metrics.trend(c.raw("events"), "event_type", "ts", "value")
    digits = lambda x: F.floor(F.col(x) * 1000 + 0.5) / 1000
    return rows.select("event_type", "day", "n", digits("mean").alias("mean"))


from corpusloom.plans.oracle import SQL  # noqa: E402
from corpusloom.plans.oracle_more import SQL as MORE  # noqa: E402

SQL = {**SQL, **MORE}

__all__ = ["QUERIES", "SQL"]
