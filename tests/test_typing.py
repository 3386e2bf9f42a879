"""Golden cases of the typing operators as small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from typeloom.functions import labels as L
from typeloom.functions import profiles as P
from typeloom.functions import sequences as S
from typeloom.operators import calling, graph, matrix, novel, policy, prefilter, schemefree
from typeloom.sinks.tables import typing_rows

HIT = "sample_id string, locus string, allele_id string, identity double, coverage double, depth double, score double, hit_ordinal long"


def hits(spark, *rows):
    return spark.createDataFrame([("s", "abc", a, float(i), float(c), d, float(i * c), n) for n, (a, i, c, d) in enumerate(rows)], HIT)


def call(spark, *rows):
    return calling.call_loci(hits(spark, *rows)).first()


def test_calls(spark):
    assert call(spark, ("1", 100, 1, None)).call_type == "exact"
    r = call(spark, ("2", 100, 1, None), ("1", 100, 1, None))
    assert r.multiple_hits and r.allele_ids == ["2", "1"]
    assert call(spark, ("1", 100, 0.9878, None)).call_type == "partial"
    assert call(spark, ("1", 96, 0.96, None)).call_type == "closest"
    assert call(spark, ("1", 80, 0.6, None)).call_type == "partial"
    r = call(spark, ("1", 80, 0.4, None))
    assert (r.call_type, r.allele_id, r.confidence) == ("missing", None, 0.0)
    assert call(spark, ("1", 100, 1, 5.0)).call_type == "partial"  # below the least depth
    assert abs(call(spark, ("1", 100, 1, 15.0)).confidence - 0.5) < 1e-12
    assert abs(call(spark, ("1", 100, 1, 400.0)).confidence - 0.9) < 1e-12


def test_rows(spark):
    schema = "sample_id string, locus string, allele_id string, call_type string, multiple_hits boolean, allele_ids array<string>, copy_count long"
    calls = spark.createDataFrame([("A", "abc", "66", "closest", False, [], 1), ("A", "def", "15", "partial", False, [], 1), ("A", "ghi", "77", "exact", False, ["77"], 1), ("A", "jkl", None, "missing", False, [], 1), ("C", "abc", "2", "exact", True, ["2", "1"], 1), ("D", "abc", "1", "exact", False, ["1"], 2)], schema)
    types = spark.createDataFrame([("A", 66, False, True), ("C", 87, True, False), ("D", 87, False, False)], "sample_id string, st long, conflicting boolean, inexact boolean")
    assert sorted(r[0] for r in typing_rows(calls, types, "vpa", count_same_copy=True).collect()) == ["A\tvpa\t-\t~66\t15?\t77\t-", "C\tvpa\t-\t1,2", "D\tvpa\t87\t1,1"]
    assert "D\tvpa\t87\t1*" in [r[0] for r in typing_rows(calls, types, "vpa").collect()]


def test_classes(spark):
    schema = "locus string, allele_id string, call_type string, multiple_hits boolean, gate_passes boolean, substring boolean, contig_length int, q_start int, q_end int, strand string, allele_length int, a_start int, a_end int, novel_sequence string"
    base = ["L", "1", "exact", False, True, False, None, None, None, "+", 9, None, None, None]

    def row(**kw):
        names = [c.split()[0] for c in schema.split(", ")]
        return tuple(kw.get(n, b) for n, b in zip(names, base, strict=True))

    rows = [row(), row(call_type="closest", multiple_hits=True), row(multiple_hits=True), row(call_type="closest", contig_length=130, q_start=5, q_end=110, allele_length=120, a_start=0, a_end=90), row(gate_passes=False), row(gate_passes=False, substring=True), row(call_type="missing", allele_id=None), row(call_type="closest", allele_length=20)]
    stats = spark.createDataFrame([("L", 9)], "locus string, mode_len int")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    gated = [r.label for r in policy.classify(df, stats, enforce_gate=True).orderBy("i").collect()]
    assert gated == ["1", "NIPH", "NIPHEM", "PLOT3", "LNF", "INF-1", "LNF", "ALM"]
    assert policy.classify(df, stats).orderBy("i").collect()[4].label == "1"


def test_contained_letter_by_letter(spark):
    """A sharp s is no double s, a sample without a name and an allele listed twice give one row."""
    alleles = spark.createDataFrame([("g", "1", "gro\u00df"), ("g", "2", "gross"), ("g", "2", "gross"), ("g", "3", "\ufb01n"), ("g", "4", "ende")], "locus string, allele_id string, seq string")
    cds = spark.createDataFrame([("a", "ein GROSS fin"), ("b", "zu gro\u1e9e"), (None, "das Ende"), (None, None)], "sample_id string, seq string")
    calls = cds.select("sample_id").distinct().join(alleles.select("locus", "allele_id").distinct())
    assert sorted(((r.sample_id, r.allele_id) for r in policy.contained(calls, alleles, cds).collect()), key=str) == [("a", "2"), ("b", "1"), (None, "4")]


def test_kmers(spark):
    a = spark.createDataFrame([("locusA", "1", "ATGCGTACGTTAGCTAGCTAATGCGTACGTTAGCTA"), ("locusA", "2", "ATGCGTACGTTAGCTAGCTAATGCGTACGTTAGCAA"), ("locusB", "1", "CCCCGGGGAAAATTTTCCCCGGGGAAAATTTTCCCC")], "locus string, allele_id string, seq string")
    c = a.filter("locus = 'locusB' or allele_id = '1'").select(F.lit("s").alias("sample_id"), F.col("locus").alias("contig_id"), F.concat(F.lit("GATC"), "seq", F.lit("GATC")).alias("seq"))
    for stride in (1, 4):
        top = prefilter.top_alleles(prefilter.kmer_scores(c, a, 21, stride), 1).collect()
        assert {(r.locus, r.allele_id) for r in top} == {("locusA", "1"), ("locusB", "1")}
    with pytest.raises(ValueError):
        S.canonical_kmers(F.lit("ACGT"), 21, 0)
    assert spark.range(1).select(S.canonical_kmers(F.lit("ACG"), 21)).first()[0] == []


def nodes(spark, rows):
    return spark.createDataFrame([(i, n, list(p)) for i, (n, p) in enumerate(rows)], "id long, label string, profile array<string>")


def test_linear_tree(spark):
    n = nodes(spark, [("s1", "111"), ("s2", "112"), ("s3", "122"), ("s4", "222")])
    tree = graph.spanning_tree(n).collect()
    assert {frozenset((r.source, r.target)) for r in tree} == {frozenset(x) for x in ((0, 1), (1, 2), (2, 3))} and all(r.weight == 1 for r in tree)
    assert {frozenset((r.source, r.target)) for r in graph.kruskal_tree(n).collect()} == {frozenset(x) for x in ((0, 1), (1, 2), (2, 3))}
    assert graph.tree_faults(n, graph.spanning_tree(n)).first().asDict() == {"edge_count_off": 0, "self_loops": 0, "extra_components": 0}


def test_missing_distances(spark):
    n = spark.createDataFrame([(["LNF", "1", "2"], ["1", "1", "1"])], "a array<string>, b array<string>").select(P.clean(F.col("a")).alias("a"), P.clean(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    assert tuple(n.select(P.symmetric(a, b), P.symmetric(a, b, True), P.asymmetric(a, b), P.asymmetric(b, a), P.asymmetric(b, a, True)).first()) == (1, 2, 2, 1, 2)


def test_collapse(spark):
    p = spark.createDataFrame([(0, "A", ["1", "1"]), (1, "B", ["1", "1"]), (2, "C", ["1", "2"])], "sample_ordinal long, sample string, profile array<string>")
    c = {r.label: r for r in matrix.collapse(p).collect()}
    assert c["A (+1)"].members == ["A", "B"] and c["C"].duplicates == 1
    tree = graph.spanning_tree(matrix.collapse(p).select(F.col("sample_ordinal").alias("id"), "label", "profile"))
    assert sorted((r.s, r.t, r.weight) for r in graph.restore_duplicates(tree, matrix.collapse(p)).collect()) == [("A", "B", 0), ("A", "C", 1)]


def test_rooted_tree(spark):
    rng = random.Random(3)
    n = 9
    edges = [(rng.randrange(i), i, rng.randint(1, 4)) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "source long, target long, weight long")
    info = spark.createDataFrame([(i, f"s {i}", 1) for i in range(n)], "id long, label string, member_count long")
    dist = np.full((n, n), 10**6)
    np.fill_diagonal(dist, 0)
    for a, b, w in edges:
        dist[a, b] = dist[b, a] = w
    for k in range(n):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
    want = min((int(dist[i].max()), int(dist[i].sum()), i) for i in range(n))
    r = graph.choose_root(info, tree).first()
    assert (r.eccentricity, r.total, r.id) == want
    hung = graph.rooted(tree, r.id)
    assert {x.id: x.distance for x in hung.collect()} == {i: int(dist[r.id, i]) for i in range(n)}
    assert {x.id: x.n_descendants for x in graph.descendants(hung).collect()}[r.id] == n - 1
    text = graph.newick(info, hung).first()[0]
    assert text.endswith(f"s_{r.id};") and text.count("s_") == n and text.count("(") == text.count(")")


def test_arborescence_against_all_trees():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 5)
        w = {(i, j): rng.randint(1, 6) for i in range(n) for j in range(n) if i != j}
        best = None
        for parents in itertools.product(range(n), repeat=n - 1):
            total, ok = 0, True
            for v, u in enumerate(parents, 1):
                if u == v:
                    ok = False
                    break
                total += w[u, v]
            for v in range(1, n):
                x, seen = v, set()
                while ok and x and x not in seen:
                    seen.add(x)
                    x = parents[x - 1]
                ok = ok and x == 0
            if ok and (best is None or total < best):
                best = total
        u, v = (np.array(x) for x in zip(*w, strict=True))
        got = graph.arborescence(n, u, v, np.array(list(w.values())), 0)
        assert len(got) == n - 1 and sum(list(w.values())[i] for i in got) == best


def test_schemefree(spark):
    g = spark.createDataFrame([(0, "locus_1", "ATCGATCGATCG"), (1, "locus_1", "atcg-ATCGATCG"), (2, "locus_1", "ATCGATCGATCC"), (3, "locus_2", "GG"), (4, "locus_2", "CC")], "gene_ordinal long, locus string, seq string")
    for strategy in ("safe", "fast", "ultra", "strict"):
        assert [r.allele_id for r in schemefree.number_alleles(g, strategy).orderBy("gene_ordinal").collect()] == ["locus_1_1", "locus_1_1", "locus_1_2", "locus_2_1", "locus_2_2"]


def test_novel(spark):
    f = spark.createDataFrame([("dnaN", "isoA", "ATGCATGC", 0), ("dnaN", "isoB", "ATGCATGC", 1), ("dnaN", "isoB", "ATGG", 2)], "locus string, sample string, seq string, ordinal long")
    out = {r.allele_id: r.samples for r in novel.novel_alleles(f).collect()}
    assert out == {"n1": ["isoA", "isoB"], "n2": ["isoB"]}
    known = spark.createDataFrame([("dnaN", "n7")], "locus string, allele_id string")
    assert {r.allele_id for r in novel.novel_alleles(f, known).collect()} == {"n8", "n9"}


def test_labels(spark):
    one = spark.range(1)
    cat = lambda a, b: one.select(L.diff_category(F.lit(a), F.lit(b))).first()[0]
    assert [cat("INF-3", "3"), cat("5", "LNF"), cat("-", "4"), cat("4", "INF-5"), cat("~4", "INF-5"), cat("~4", "5"), cat("4", "NIPH"), cat("4", "5")] == ["consistent", "chew_LNF_ours_found", "ours_LNF_chew_found", "chew_INF_ours_exact", "both_INF_diff_allele", "ours_closest_chew_exact", "chew_NIPH", "other"]
    assert one.select(L.normalise_allele(F.lit(" ~INF-5? "))).first()[0] == "5"
    assert [r[0] for r in one.select(F.explode(F.array(*[L.novel_cell(F.lit(x)) for x in ("3", "~3", "1,2", "4*", " ")]))).collect()] == ["3", "-", "-", "4*", "-"]


def test_readers(spark, tmp_path):
    from typeloom.sources import text as T

    (tmp_path / "a.fa").write_text(">c1 some\nacgt\nAC\n>c2\nGG\n")
    assert [(r.contig_id, r.seq) for r in T.read_fasta(spark, f"file://{tmp_path}/a.fa").orderBy("contig_id").collect()] == [("c1", "ACGTAC"), ("c2", "GG")]
    (tmp_path / "b.tsv").write_text("# x\narcC_1\tctg\t100.0\t480\t480\t1\t480\t900\t421\t0\t880\n\nshort\t1\n")
    r = T.read_blast(spark, f"file://{tmp_path}/b.tsv").collect()
    assert len(r) == 1 and (r[0].locus, r[0].allele_id, r[0].coverage, r[0].strand) == ("arcC", "1", 1.0, "-")
    (tmp_path / "c.paf").write_text("a_1\t100\t0\t90\t+\tctg\t500\t10\t100\t90\t90\t60\tNM:i:10\n")
    r = T.read_paf(spark, f"file://{tmp_path}/c.paf").first()
    assert (r.identity, r.coverage) == (90.0, 0.9)
    (tmp_path / "m.csv").write_text("FILE,SCHEME,ST,L1,L2\ns1,vpa,-,1,\n")
    assert [(x.sample, x.locus, x.value) for x in T.read_profile_matrix(spark, f"file://{tmp_path}/m.csv").orderBy("locus").collect()] == [("s1", "L1", "1"), ("s1", "L2", "")]


def test_stream_equals_batch(spark, tmp_path):
    from typeloom.streaming.novel import follow

    schema = "locus string, sample string, seq string, ordinal long"
    rows = [("a", "x", "AC", 0), ("a", "y", "AC", 1), ("a", "y", "GG", 2), ("b", "x", "TT", 3)]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        q = follow(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
        q.awaitTermination(60)
    from typeloom.streaming.novel import written

    stream = {(r.locus, r.allele_id, r.seq) for r in written(spark, f"file://{tmp_path}/out").collect()}
    batch = {(r.locus, r.allele_id, r.seq) for r in novel.novel_alleles(spark.createDataFrame(rows, schema)).collect()}
    assert stream == batch


def test_stream_batch_that_runs_again(spark, tmp_path):
    from typeloom.streaming.novel import write_batch, written

    path, schema = f"file://{tmp_path}/out", "locus string, sample string, seq string, ordinal long"
    batches = [[("a", "s1", "ACGT", 1), ("a", "s2", "acgt", 2), ("b", "s1", "TT", 3)], [("a", "s3", "ACGT", 4), ("a", "s1", "GG", 5), ("a", "s3", "GG", 6)], [("a", "s2", "ACGT", 7), ("b", "s9", "CC", 8)]]
    want = {("a", "n1", ("s1", "s2", "s3")), ("b", "n1", ("s1",)), ("a", "n2", ("s1", "s3")), ("b", "n2", ("s9",))}
    for number, rows in enumerate(batches):
        for _ in range(2):  # the same batch twice, as after a failure
            write_batch(spark.createDataFrame(rows, schema), number, path)
    assert {(r.locus, r.allele_id, tuple(r.samples)) for r in written(spark, path).collect()} == want
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        write_batch(spark.createDataFrame(batches[1], schema), 1, f"file://{tmp_path}/nowhere")


def _tree_nodes(spark, n=30, loci=12, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 4, loci)
    rows = []
    for i in range(n):
        base = np.where(rng.random(loci) < 0.2, rng.integers(1, 6, loci), base) if i % 5 else rng.integers(1, 4, loci)
        rows.append((i, f"S{(i * 7) % n}", ["-" if rng.random() < 0.15 else str(x) for x in base], int(rng.integers(1, 4))))
    return spark.createDataFrame(rows, "id long, label string, profile array<string>, member_count long")


def test_recrafted_trees_are_trees_and_settle(spark):
    from typeloom.operators import graph, recraft
    from typeloom.operators.matrix import pairs

    nodes = _tree_nodes(spark)
    moved = 0
    for tree in (recraft.recrafted_tree(nodes), recraft.weighted_tree(nodes)):
        rows = tree.collect()
        parent = {r.target: r.source for r in rows}
        assert len(rows) == len(parent) == 29
        for x in parent:
            seen = {x}
            while x in parent:
                x = parent[x]
                assert x not in seen
                seen.add(x)
    edges = pairs(nodes, directed=True).toPandas()
    m = {c: np.zeros((30, 30), int) for c in ("combined_weight", "asymmetric_weight", "weight")}
    for c, x in m.items():
        x[edges["source"], edges["target"]] = edges[c]
    info = nodes.toPandas().sort_values("id")
    rank = np.unique(info["label"].str.lower(), return_inverse=True)[1]
    resolved = np.array([sum(v != "-" for v in p) for p in info["profile"]])
    plain = np.full(30, -1)
    for r in graph.spanning_tree(nodes).collect():
        plain[r.target] = r.source
    after = recraft.recraft(plain, *m.values(), resolved, rank)
    again = recraft.recraft(after, *m.values(), resolved, rank)
    assert (after == again).all()
    got = np.full(30, -1)
    for r in recraft.recrafted_tree(nodes).collect():
        got[r.target] = r.source
    assert (got == after).all()
    # no branch has a candidate left that the rule prefers
    comb, asym, sym = m.values()
    tree = recraft.Tree(after)
    for x in range(30):
        old = after[x]
        under = tree.below(x)
        moved += old != plain[x]
        for y in range(30):
            if old < 0 or y in under or y == old:
                continue
            allowed = comb[y, x] <= comb[old, x] + (sym[old, x] != 0) and asym[y, x] <= asym[old, x] and (comb[y, under].sum(), asym[y, under].sum()) <= (comb[old, under].sum(), asym[old, under].sum())
            score = lambda p, x=x, under=under: (sum(max(0, resolved[d] - resolved[p]) for d in under), max(0, resolved[x] - resolved[p]), comb[p, x], asym[p, x], -resolved[p], sym[p, x], rank[p], p)
            assert not allowed or score(y) > score(old)


def test_recrafting_looks_again_only_at_what_changed():
    """The tree that a plain queue makes, with one look for each node and for each change of a parent or a branch."""
    from collections import deque

    from typeloom.operators import recraft

    class Counted(np.ndarray):
        looks = 0

        def __getitem__(self, where):
            Counted.looks += isinstance(where, tuple) and isinstance(where[0], slice)
            return np.asarray(self)[where]

    queued = allowed = looked = 0
    for seed in range(6):
        n, loci = 60, 8
        rng = np.random.default_rng(seed)
        codes = rng.integers(1, 4, (n, loci)) * (rng.random((n, loci)) > 0.2)
        has = codes > 0
        apart = (codes[:, None, :] != codes[None, :, :]) & has[None, :, :]
        sym, asym = (apart & has[:, None, :]).sum(2), apart.sum(2)
        comb, resolved, rank = asym * (loci + 1) + sym, has.sum(1), rng.permutation(n)
        parent = np.array([-1, *[int(rng.integers(0, x)) for x in range(1, n)]])
        tree, todo = recraft.Tree(parent.copy()), deque(range(n))
        allowed += n
        while todo:
            x = todo.popleft()
            queued += 1
            old = int(tree.parent[x])
            if old < 0:
                continue
            under = tree.below(x)
            cost = lambda y, under=under: (comb[y, under].sum(), asym[y, under].sum())
            some = [y for y in range(n) if y != old and y not in under and comb[y, x] <= comb[old, x] + (sym[old, x] != 0) and asym[y, x] <= asym[old, x] and cost(y) <= cost(old)]
            score = lambda y, x=x, under=under: (sum(max(0, resolved[d] - resolved[y]) for d in under), max(0, resolved[x] - resolved[y]), comb[y, x], asym[y, x], -resolved[y], sym[y, x], rank[y], y)
            best = min([old, *some], key=score)
            if best != old:
                over = {x, old, best, *tree.above(old), *tree.above(best)}
                allowed += len(over)
                around = over | {*under, *tree.children[old], *tree.children[best]}
                tree.move(x, best)
                todo.extend(sorted(around))
        Counted.looks = 0
        got = recraft.recraft(parent, comb.view(Counted), asym, sym, resolved, rank)
        assert (got == tree.parent).all() and (got != parent).any()
        looked += Counted.looks
    assert looked <= allowed < queued


def test_faults_of_trees_take_few_jobs(spark):
    """Faults as a walk through the edges finds them, also of edges that make no tree; and a long path takes no more jobs
    than a short one."""
    rng = np.random.default_rng(7)
    edges = {"path": [(x, x + 1) for x in range(199)], "none": [], "loops": [(5, 5), (5, 5), (1, 2)], "stranger": [(0, 1), (1, 900), (900, 2)], "both ways": [(3, 4), (4, 3), (3, 4)]}
    edges["any"] = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))]
    nodes, want = spark.range(200), {}
    for name, pairs in edges.items():
        near = {x: {x} for x in range(200)}
        for a, b in pairs:
            if a in near and b in near:
                near[a].add(b)
                near[b].add(a)
        left, parts = set(near), 0
        while left:
            todo, parts = [left.pop()], parts + 1
            while todo:
                new = near[todo.pop()] & left
                left -= new
                todo += new
        want[name] = (abs(199 - len(pairs)), sum(a == b for a, b in pairs), parts - 1)
    schema = "tree string, source long, target long"
    rows = spark.createDataFrame([(name, *e) for name, pairs in edges.items() for e in pairs], schema).repartition(3)
    group = lambda name: spark.sparkContext.setJobGroup(name, name)
    jobs = lambda name: len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    try:
        group("one")
        for name in edges:
            got = graph.tree_faults(nodes, rows.filter(F.col("tree") == name).drop("tree")).first()
            assert tuple(got) == want[name]
        group("path")
        graph.tree_faults(nodes, rows.filter("tree = 'path'").drop("tree")).collect()
        assert jobs("path") <= 12
        group("all")
        assert {r[0]: tuple(r)[1:] for r in graph.forest_faults(nodes, rows, list(edges)).collect()} == want
        assert jobs("all") <= 12
    finally:
        group("rest")
    assert tuple(graph.tree_faults(spark.range(1), rows.filter("tree = 'none'")).first()) == (0, 0, 0)


def test_every_tree_is_that_of_its_operator(spark):
    from typeloom.operators import recraft
    from typeloom.storage import table

    nodes = table(_tree_nodes(spark, n=40, loci=7, seed=5), "nodes")
    got = recraft.every_tree(nodes).collect()
    for name, tree in zip(recraft.TREES, (graph.kruskal_tree(nodes), graph.spanning_tree(nodes), recraft.recrafted_tree(nodes), recraft.weighted_tree(nodes)), strict=True):
        assert sorted((r.source, r.target) for r in got if r.tree == name) == sorted((r.source, r.target) for r in tree.collect())
    assert len(got) == 4 * 39
    assert recraft.every_tree(nodes.filter("id = 3")).count() == 0
    with pytest.raises(ValueError, match="over the limit"):
        recraft.every_tree(spark.range(5001).select("id", F.lit("s").alias("label"), F.array(F.lit("1")).alias("profile"), F.lit(1).cast("long").alias("member_count")))


def test_shortcuts_and_ancestry():
    from typeloom.operators import recraft

    rng = np.random.default_rng(3)
    dist = rng.integers(0, 9, (12, 12)).astype(float)
    np.fill_diagonal(dist, 0)
    rank = recraft.harmonic_ranks(dist, rng.integers(1, 4, 12))
    assert sorted(rank) == list(range(12))
    got = recraft.shortcuts(dist, rank)
    for t in range(12):
        near = sorted((rank[s], dist[s, t], s) for s in range(12) if s != t and dist[s, t] < 3 and rank[s] < rank[t])
        assert got[t] == (near[0][2] if near else -1)
    assert recraft.contemporary(1, 1, 0, 3, 10) and recraft.contemporary(0, 1, 2, 3, 10) and recraft.contemporary(1, 1, 2, 0, 10)
    p, q = 0.2, 0.3
    s1, s2 = 1 - (1 - p) * (1 - q), 1 - q
    for cand in range(1, 10):
        null, alt = cand * np.log(s1) + (10 - cand) * np.log(1 - s1), 4 * np.log(s2) + 6 * np.log(1 - s2)
        assert recraft.contemporary(2, 3, cand, 4, 10) == (null >= alt)


def test_least_arborescence_against_all_trees(spark):
    """Total cost against every choice of one parent for each node that makes a tree, over all roots."""
    from itertools import product

    from typeloom.operators import graph
    from typeloom.operators.matrix import pairs

    for seed in range(3):
        nodes = _tree_nodes(spark, n=5, loci=6, seed=seed)
        cost = {(r.source, r.target): r.combined_weight for r in pairs(nodes, directed=True).collect()}
        best = None
        for root in range(5):
            rest = [x for x in range(5) if x != root]
            for ps in product(range(5), repeat=4):
                parent = dict(zip(rest, ps, strict=True))
                if any(x == p for x, p in parent.items()):
                    continue
                ok = True
                for x in rest:
                    seen = set()
                    while x in parent and x not in seen:
                        seen.add(x)
                        x = parent[x]
                    ok = ok and x == root
                if ok:
                    total = sum(cost[p, x] for x, p in parent.items())
                    best = total if best is None else min(best, total)
        assert sum(r.combined_weight for r in graph.spanning_tree(nodes).collect()) == best


def test_clusters_of_long_trees(spark):
    """Names that go up and down along a path of 400 nodes, and a tree of it; the old rounds did not settle on such."""
    order = list(range(400))
    random.Random(2).shuffle(order)
    for ids in (order, [x for k in range(100) for x in (k, 399 - k, 100 + k, 299 - k)], list(range(400))):
        edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(ids, ids[1:], strict=False) if x != ids[250]], "a long, b long")
        got = {r.id: r.cluster for r in graph.clusters(spark.range(400), edges).collect()}
        assert got == {x: min(part) for part in (ids[:251], ids[251:]) for x in part}


def test_trees_beyond_the_list_of_pairs(spark):
    """The same tree as from a list of all edges, also where ties abound and a node's nearest sources are used up; and a
    whole tree of more nodes than the limit, when it is forced."""
    import pandas as pd
    import pyarrow as pa

    from typeloom.operators import dense

    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(2, 30))
        ids = rng.permutation(3 * n)[:n]
        p = dense.Profiles(pa.table({"id": pa.array(ids, pa.int64()), "label": [f"S{i % 5}" for i in ids], "sl": [f"s{i % 5}" for i in ids], "p": pa.array([[None if rng.random() < 0.2 else str(x) for x in rng.integers(0, 3, 5)] for _ in ids], pa.list_(pa.string()))}))
        i, j = np.nonzero(~np.eye(n, dtype=bool))
        edges = pd.DataFrame({"source": p.ids[i], "target": p.ids[j], "combined_weight": p.combined[i, j], "asymmetric_weight": p.asymmetric[i, j], "sl": [f"s{x % 5}" for x in p.ids[i]]})
        every = np.arange(n)
        parent = dense.least_parents(n, lambda t, p=p, e=every: p.combined[np.ix_(e, t)] * 6 * len(e) + p.asymmetric[np.ix_(e, t)], p.place, nearest=2)
        assert {(p.ids[parent[t]], p.ids[t]) for t in every if parent[t] >= 0} == {(r.source, r.target) for r in graph.least_tree(edges).itertuples()}
    nodes = spark.range(5001).select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("label"), F.expr("transform(sequence(0, 6), k -> string(pmod(shiftright(id, 2 * k), 4)))").alias("profile"))
    with pytest.raises(ValueError, match="over the limit"):
        graph.spanning_tree(nodes)
    tree = graph.spanning_tree(nodes, force=True).toPandas()
    assert len(tree) == 5000 and tree["target"].is_unique and (tree["weight"] == 1).all()


def _wide_nodes(spark, n, loci, values, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(3 * i), f"S{i % 4}", [None if rng.random() < 0.2 else "LNF" if rng.random() < 0.1 else str(x) for x in rng.integers(0, values, loci)]) for i in range(n)]
    rows += [(1000 + i, f"s{i % 3}", r[2]) for i, r in enumerate(rows[: n // 3])] + [(2000, "none", [None] * loci)]
    return spark.createDataFrame(rows, "id long, label string, profile array<string>")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("loci", "values"), [(7, 3), (1, 1), (30, 70), (90, 5), (300, 40)])
def test_packed_pairs(spark, loci, values):
    """Packed words count as the plain expressions do, and no pair is compared locus by locus up to 16 words."""
    nodes = _wide_nodes(spark, 12, loci, values)
    a = nodes.select(F.col("id").alias("source"), P.clean(F.col("profile")).alias("a"))
    b = nodes.select(F.col("id").alias("target"), P.clean(F.col("profile")).alias("b"))
    both = a.join(b, F.col("source") != F.col("target"))
    for missing in (False, True):
        got = matrix.pairs(nodes, directed=True, include_missing=missing)
        assert loci > 200 or "zip_with" not in _plan(got)
        want = both.select("source", "target", P.symmetric(F.col("a"), F.col("b"), missing), P.asymmetric(F.col("a"), F.col("b"), missing))
        rows = got.collect()
        assert sorted(tuple(r)[:4] for r in rows) == sorted(map(tuple, want.collect())) and all(r.combined_weight == r.asymmetric_weight * (loci + 1) + r.weight for r in rows)


@pytest.mark.parametrize(("loci", "values"), [(7, 3), (1, 1), (40, 70), (60, 3)])
def test_normalised_pairs(spark, loci, values):
    nodes = _wide_nodes(spark, 12, loci, values)
    a = nodes.select(F.col("id").alias("source"), P.clean(F.col("profile")).alias("a"))
    b = nodes.select(F.col("id").alias("target"), P.clean(F.col("profile")).alias("b"))
    want = a.join(b, F.col("source") != F.col("target")).select("source", "target", F.round(P.normalised_asymmetric(F.col("a"), F.col("b")), 9), F.round(P.normalised_symmetric(F.col("a"), F.col("b")), 9))
    got = matrix.normalised_pairs(nodes)
    assert loci > 40 or "zip_with" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("n", "loci", "values"), [(12, 7, 2), (20, 2, 2), (1, 3, 2), (12, 300, 40)])
def test_least_sources(spark, n, loci, values):
    """As over all pairs, with copies, ties of labels and a node without values, but pairs are of profiles."""
    nodes = _wide_nodes(spark, n, loci, values)
    want = graph.least_incoming(matrix.pairs(nodes, directed=True), nodes).collect()
    assert sorted(map(tuple, matrix.least_sources(nodes).collect())) == sorted(map(tuple, want))
