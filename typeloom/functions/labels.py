"""Allele labels: call types, confidence, cell formatting, surveillance classes, normalisation and diff categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that stand for a missing allele in profile matrices, and in the two report scripts.
MISSING = ("", "-", "LNF", "NIPH", "NIPHEM", "ASM", "ALM", "PLOT3", "PLOT5", "LOTSC", "PAMA", "PLNF")
MISSING_REPORT = ("", "-", "LNF", "NIPH", "ALM", "ASM", "PLOT3", "PLOT5")
#: Lengths beyond this share of the locus mode are too short or too long.
SIZE_TOLERANCE = 0.2


def call_type(identity: Column, coverage: Column) -> Column:
    """Class of one hit. The limits are constants, apart from the filter's thresholds."""
    return F.when((identity == 100) & (coverage >= 1), "exact").when((identity >= 95) & (coverage >= 0.95), "closest").when(coverage >= 0.95, "novel").when(coverage > 0, "partial").otherwise("missing")


def confidence(identity: Column, coverage: Column, depth: Column) -> Column:
    """identity share times coverage; with a depth also min(depth / 30, 1), less a tenth beyond 300."""
    base = identity / 100 * coverage
    scaled = base * F.least(depth / 30, F.lit(1.0))
    return F.when(depth.isNull(), base).when(depth > 300, scaled * 0.9).otherwise(scaled)


def normalise_allele(value: Column) -> Column:
    """Trimmed, without one leading ~, one trailing ?, one leading INF-, in this order."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "^~", ""), r"\?$", ""), "^INF-", "")


def is_missing(value: Column, tokens: tuple[str, ...] = MISSING) -> Column:
    return F.upper(F.trim(F.coalesce(value, F.lit("")))).isin(*tokens)


def is_numeric(value: Column) -> Column:
    return value.rlike("^[0-9]+$")


def allele_order(value: Column) -> list[Column]:
    """Sort keys: numbers first by value, then text."""
    return [F.when(is_numeric(value), 0).otherwise(1), F.when(is_numeric(value), value.try_cast("bigint")), value]


def detail_suffix(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat(F.lit(";"), part(contig), F.lit(":"), part(start), F.lit("-"), part(end), F.lit(":"), part(strand))


def format_cell(call: Column, allele: Column, allele_ids: Column, multiple: Column, copies: Column, label: Column, count_same_copy: bool = False) -> Column:
    """A cell of the typing table. A class label wins, then missing, several alleles, copies, and the call's mark."""
    ordered = F.array_join(F.transform(F.array_sort(F.transform(allele_ids, lambda a: F.struct(F.when(a.rlike("^[0-9]+$"), 0).otherwise(1).alias("t"), F.coalesce(a.try_cast("bigint"), F.lit(0)).alias("n"), a.alias("a")))), lambda s: s["a"]), ",")
    copied = (call == "exact") & (copies > 1)
    repeat = F.array_join(F.array_repeat(allele, F.greatest(copies.cast("int"), F.lit(1))), ",") if count_same_copy else F.concat(allele, F.lit("*"))
    return (
        F.when(label.isNotNull(), label)
        .when((call == "missing") | allele.isNull(), "-")
        .when(multiple & (F.size(allele_ids) > 1), ordered)
        .when(copied, repeat)
        .when(call == "exact", allele)
        .when(call.isin("closest", "novel"), F.concat(F.lit("~"), allele))
        .otherwise(F.concat(allele, F.lit("?")))
    )


def edge_class(contig_length: Column, q_start: Column, q_end: Column, strand: Column, allele_length: Column, a_start: Column, a_end: Column) -> Column:
    """LOTSC, PLOT5 or PLOT3 if the allele would run over the contig's end; null if a coordinate is unknown.

    The unaligned rest before and after the match, by strand, is held against the room left on the contig.
    """
    room_left, room_right = q_start, contig_length - q_end
    rest_left, rest_right = a_start, allele_length - a_end
    plus = F.coalesce(strand, F.lit("-")) == "+"
    five = F.when(plus, room_left < rest_left).otherwise(room_right < rest_left)
    three = F.when(plus, room_right < rest_right).otherwise(room_left < rest_right)
    known = F.lit(True)
    for c in (contig_length, q_start, q_end, allele_length, a_start, a_end):
        known = known & c.isNotNull()
    return F.when(known & (contig_length < allele_length), "LOTSC").when(known & five, "PLOT5").when(known & three, "PLOT3")


def size_class(length: Column, mode: Column) -> Column:
    """ASM or ALM beyond a fifth (whole characters) of the locus mode."""
    slack = (mode * SIZE_TOLERANCE).cast("int")
    return F.when(length < mode - slack, "ASM").when(length > mode + slack, "ALM")


def chew_class(call: Column, allele: Column, multiple: Column, gate_fails: Column, substring: Column, edge: Column, size: Column) -> Column:
    """The decision list of surveillance classes; gate_fails is true only if a gate is on and its hash is absent."""
    inferred = F.coalesce(F.concat(F.lit("INF-"), allele), F.lit("INF"))
    open_ = F.when((call == "exact") & allele.isNotNull(), allele).when(edge.isNotNull(), edge).when(size.isNotNull(), size).when(call.isin("closest", "novel"), inferred).when(call == "partial", "LNF").otherwise(F.coalesce(allele, F.lit("LNF")))
    shut = F.when(edge.isNotNull(), edge).when(size.isNotNull(), size).when(substring, inferred).otherwise("LNF")
    return F.when(multiple, F.when(call == "exact", "NIPHEM").otherwise("NIPH")).when(call == "missing", "LNF").when(gate_fails, shut).otherwise(open_)


#: Class labels that are buckets of their own.
BUCKETS = ("EXC", "INF", "LNF", "PLOT3", "PLOT5", "LOTSC", "NIPH", "NIPHEM", "ALM", "ASM", "PAMA", "PLNF")
#: Tokens that the normalisation of discrepancies does not decide on, and reasons that explain a difference.
UNDECIDED = ("", "-", "LNF", "NIPH", "ALM", "ASM", "PLOT3", "PLOT5", "LOTSC")
BOUNDARY_REASONS = ("five_prime_boundary_shift", "three_prime_boundary_shift")


def label_bucket(label: Column) -> Column:
    """Blank and - are LNF; letters count as they are."""
    v = F.trim(F.coalesce(label, F.lit("")))
    return F.when(v.isin("", "-"), "LNF").when(is_numeric(v), "NUMERIC").when(v.startswith("INF-"), "INF").when(v.isin(*BUCKETS), v).otherwise("OTHER")


def run_normal(value: Column) -> Column:
    """Norm of the run comparison: INF-x, ~x and x? are x."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "^INF-", ""), "^~", ""), r"\?$", "")


def diff_category(ours: Column, other: Column, name: str = "ours", other_name: str = "chew") -> Column:
    """Nine labels, first match, made from the names of the two callers."""
    lost = lambda v: v.isin("-", "LNF")
    inf = lambda v: v.startswith("INF-")
    near = lambda v: v.startswith("~")
    return (
        F.when(run_normal(ours) == run_normal(other), "consistent")
        .when(lost(other) & ~lost(ours), f"{other_name}_LNF_{name}_found")
        .when(lost(ours) & ~lost(other), f"{name}_LNF_{other_name}_found")
        .when(inf(other) & ~ours.startswith("INF") & ~near(ours), f"{other_name}_INF_{name}_exact")
        .when(inf(ours) & ~inf(other) & ~near(other), f"{name}_INF_{other_name}_exact")
        .when((inf(ours) | near(ours)) & inf(other), "both_INF_diff_allele")
        .when(near(ours) & ~inf(other) & ~near(other), f"{name}_closest_{other_name}_exact")
        .when(other.isin("NIPH", "NIPHEM"), f"{other_name}_NIPH")
        .otherwise("other")
    )


def verdict(ours: Column, other: Column, found: Column, exact: Column, hits: Column, name: str = "ours", other_name: str = "chew") -> Column:
    """Eight labels, first match: our allele found in the genome, the other's CDS exact, number of hits."""
    lost = other.isin("-", "LNF")
    near = ours.startswith("INF-") | ours.startswith("~")
    return (
        F.when(other.isin("NIPH", "NIPHEM"), F.when(hits >= 2, f"{other_name}_niph_verified").otherwise(f"{other_name}_niph_unverified"))
        .when(other.startswith("INF-") & exact, F.when(found, "cds_boundary_diff").otherwise(f"{other_name}_inf_bsr_bug"))
        .when(lost & found, f"{name}_correct")
        .when(near & exact, F.when(found, "cds_boundary_diff").otherwise(f"{other_name}_correct"))
        .when(~near & ~ours.isin("-", "LNF") & lost, f"{name}_correct")
        .when(found & exact, "cds_boundary_diff")
        .when(found, f"{name}_correct")
        .when(exact, f"{other_name}_correct")
        .otherwise("both_unverified")
    )


def normalisation_decision(query: Column, reference: Column, reason: Column, subreason: Column, anchor: str = "reference") -> tuple[Column, Column, Column]:
    """(decision, why, normalised call) of a discrepancy; the anchor's side is taken where one is accepted."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    q, r, because, detail = blank(query), blank(reference), blank(reason), blank(subreason)
    near = lambda v: v.rlike("^~[0-9]+$")
    by_reference = anchor == "reference"
    decided = (
        (q == r, "unchanged", F.lit("raw_equal"), q),
        (is_missing(q, UNDECIDED) | is_missing(r, UNDECIDED), "escalate", F.lit("missing_or_special_class"), None),
        (is_numeric(q) & is_numeric(r) & because.isin(*BOUNDARY_REASONS), "accept", F.concat(F.lit("boundary_shift::"), because, F.lit("::"), detail), r if by_reference else q),
        (is_numeric(q) & is_numeric(r), "escalate", F.lit("strict_numeric_diff_without_boundary_evidence"), None),
        (near(q) & is_numeric(r), "accept", F.lit("prodigal_anchor_reference_numeric_over_non_exact"), r) if by_reference else (near(q) & is_numeric(r), "escalate", F.lit("non_exact_query_requires_manual_review"), None),
        (is_numeric(q) & near(r), "escalate", F.lit("non_exact_reference_requires_manual_review"), None) if by_reference else (is_numeric(q) & near(r), "accept", F.lit("prodigal_anchor_query_numeric_over_non_exact"), q),
        (F.lit(True), "escalate", F.lit("non_numeric_or_complex_difference"), None),
    )
    pick = lambda part: F.coalesce(*[F.when(rule[0], part(rule)) for rule in decided])
    return pick(lambda x: F.lit(x[1])), pick(lambda x: x[2]), pick(lambda x: F.lit("") if x[3] is None else x[3])


def locus_diff(left: Column, right: Column) -> Column:
    l, r = is_missing(left), is_missing(right)
    return F.when(l & r, "both_missing").when(l, "left_missing").when(r, "right_missing").otherwise("allele_difference")


def novel_cell(value: Column) -> Column:
    """A typing cell as an allele of a novel profile: blank, - or marked cells become -."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when((v == "") | (v == "-") | v.rlike("[~?,]"), "-").otherwise(v)


def warnings(locus: Column, call: Column, allele: Column, identity: Column, coverage: Column, multiple: Column) -> Column:
    """The warnings of a call, as an array; identity and coverage are null where no hit is at hand. Texts are fixed values."""
    percent = F.coalesce(F.concat(F.bround(coverage * 100, 0).cast("bigint").cast("string"), F.lit("%")), F.lit("unknown"))
    about = F.concat(F.lit("Locus '"), locus, F.lit("'"))
    one = (
        F.when(call == "missing", F.concat(about, F.lit(" not found in assembly")))
        .when(call == "partial", F.concat(about, F.lit(" has partial coverage ("), percent, F.lit(")")))
        .when(call.isin("closest", "novel") & identity.isNotNull(), F.concat(about, F.lit(" allele "), F.coalesce(allele, F.lit("None")), F.lit(": "), F.format_string("%.1f", F.bround(identity, 1)), F.lit("% identity (possible novel allele)")))
    )
    many = F.when(F.coalesce(multiple, F.lit(False)), F.concat(about, F.lit(": multiple high-quality hits (possible paralog)")))
    return F.array_compact(F.array(one, many))
