"""Composite plans: batch dedupe, cross-check, pre-screen and external matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.operators import blocking, canonical, profiles, rules, tiles
from concord.operators.components import connected_components
from concord.session import cut


#: Rows of a block beyond which it is dealt over salts.
HOT = 1000


@dataclass
class Linked:
    """Lazy results of a dedupe: records and all classified pairs; the rest is derived."""

    canon: DataFrame
    pairs: DataFrame
    velocity: float = 6.5

    def of(self, kind: str) -> DataFrame:
        return self.pairs.where(F.col("classification") == kind)

    def held(self) -> DataFrame:
        """The classified pairs as a table, for what reads them more than once."""
        if "_held" not in self.__dict__:
            self.__dict__["_held"] = cut(self.pairs, "classified")
        return self.__dict__["_held"]

    def clusters(self) -> DataFrame:
        """``(cluster_id, vid)`` of the components of AUTO pairs; ids number the components by least id."""
        ids = self.canon.select("vid", F.xxhash64("vid").alias("node"))
        edges = self.of(rules.AUTO).select(F.xxhash64("vid_a").alias("u"), F.xxhash64("vid_b").alias("v"))
        members = cut(connected_components(edges).join(ids, "node").select("component", "vid"), "members")
        roots = members.groupBy("component").agg(F.min("vid").alias("root"))
        return number_by(roots, "root", "cluster_id").join(members, "component").select("cluster_id", "vid")

    def unique(self) -> DataFrame:
        """Records in no AUTO or REVIEW pair."""
        linked = self.__dict__.get("_held", self.pairs).where(F.col("classification") != rules.NOT_DUP)
        ids = linked.select(F.explode(F.array("vid_a", "vid_b")).alias("vid"))
        return self.canon.join(ids, "vid", "left_anti")

    def summary(self) -> DataFrame:
        """One row a class: pairs, distinct ids on either side, hours at the given velocity."""
        each = self.pairs.select("classification", F.explode(F.array(F.struct(F.col("vid_a").alias("vid"), F.lit(1).alias("own")), F.struct(F.col("vid_b").alias("vid"), F.lit(0).alias("own")))).alias("x"))
        ids = each.groupBy("classification", "x.vid").agg(F.sum("x.own").alias("own"))
        counts = ids.groupBy("classification").agg(F.sum("own").alias("pairs"), F.count("*").alias("vids"))
        return counts.withColumn("hours", F.bround(F.col("vids") / F.lit(self.velocity), 1))

    def rule_counts(self) -> DataFrame:
        return self.pairs.groupBy("classification", "rule").agg(F.count("*").alias("pairs"))

    def involvement(self) -> DataFrame:
        """Ids in AUTO only, REVIEW only, both."""
        each = self.pairs.where(F.col("classification") != rules.NOT_DUP).select("classification", F.explode(F.array("vid_a", "vid_b")).alias("vid"))
        own = each.groupBy("vid").agg(F.max((F.col("classification") == rules.AUTO).cast("int")).alias("auto"), F.max((F.col("classification") == rules.REVIEW).cast("int")).alias("review"))
        kind = F.when((F.col("auto") == 1) & (F.col("review") == 1), "BOTH").when(F.col("auto") == 1, "AUTO_ONLY").otherwise("REVIEW_ONLY")
        return own.groupBy(kind.alias("involvement")).agg(F.count("*").alias("vids"))

    def tagged(self) -> DataFrame:
        """Each linked record with its counterpart, both ways round, and the unique ones: AUTO before REVIEW before UNIQUE."""
        rank = F.when(F.col("classification") == rules.AUTO, 0).when(F.col("classification") == rules.REVIEW, 1).otherwise(2)
        ab = self.held().where(F.col("classification") != rules.NOT_DUP)
        both = ab.select(F.col("vid_a").alias("vid"), F.col("vid_b").alias("match_vid"), "classification", "rule", "score").unionByName(ab.select(F.col("vid_b").alias("vid"), F.col("vid_a").alias("match_vid"), "classification", "rule", "score"))
        alone = self.unique().select("vid", F.lit("").alias("match_vid"), F.lit("UNIQUE").alias("classification"), F.lit("").alias("rule"), F.lit(0).alias("score"))
        return both.unionByName(alone).withColumn("status_rank", rank)


@dataclass
class Grouped(Linked):
    """The same, from classified pairs of groups of like records (``operators.profiles``), a table; ``records`` have their group ``gid``."""

    classes: DataFrame | None = None
    records: DataFrame | None = None

    def held(self) -> DataFrame:
        return self.pairs

    def _groups(self, *more: str) -> DataFrame:
        """The groups of either side of each pair of groups, with their sizes."""
        side = lambda s: F.struct(F.col(f"vid_{s}").alias("gid"), F.col(f"n_{s}").alias("n"))
        return self.classes.select(*more, F.explode(F.array(side("a"), side("b"))).alias("g")).select(*more, "g.*")

    def clusters(self) -> DataFrame:
        auto = self.classes.where(F.col("classification") == rules.AUTO).select("vid_a", "vid_b")
        linked = connected_components(auto, "vid_a", "vid_b")
        # a group may link with itself only
        alone = auto.where("vid_a = vid_b").select(F.col("vid_a").alias("node")).join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
        members = cut(linked.unionByName(alone).withColumnRenamed("node", "gid").join(self.records.select("gid", "vid"), "gid").select("component", "vid"), "members")
        roots = members.groupBy("component").agg(F.min("vid").alias("root"))
        return number_by(roots, "root", "cluster_id").join(members, "component").select("cluster_id", "vid")

    def unique(self) -> DataFrame:
        linked = self._groups("classification").where(F.col("classification") != rules.NOT_DUP).select("gid").distinct()
        return self.records.join(linked, "gid", "left_anti").drop("gid", "n")

    def _weighted(self) -> DataFrame:
        """Pairs of groups with the number of pairs of records that they stand for."""
        n = F.col("n_a")
        return self.classes.withColumn("weight", F.when(F.col("vid_a") == F.col("vid_b"), (n * (n - 1)).cast("decimal(38,0)") / 2).otherwise(n.cast("decimal(19,0)") * F.col("n_b")).cast("long"))

    def summary(self) -> DataFrame:
        pairs = self._weighted().groupBy("classification").agg(F.sum("weight").alias("pairs"))
        ids = self._groups("classification").groupBy("classification", "gid").agg(F.max("n").alias("n"))
        counts = pairs.join(ids.groupBy("classification").agg(F.sum("n").alias("vids")), "classification")
        return counts.withColumn("hours", F.bround(F.col("vids") / F.lit(self.velocity), 1))

    def rule_counts(self) -> DataFrame:
        return self._weighted().groupBy("classification", "rule").agg(F.sum("weight").alias("pairs"))

    def involvement(self) -> DataFrame:
        each = self._groups("classification").where(F.col("classification") != rules.NOT_DUP)
        own = each.groupBy("gid").agg(F.max("n").alias("n"), F.max((F.col("classification") == rules.AUTO).cast("int")).alias("auto"), F.max((F.col("classification") == rules.REVIEW).cast("int")).alias("review"))
        kind = F.when((F.col("auto") == 1) & (F.col("review") == 1), "BOTH").when(F.col("auto") == 1, "AUTO_ONLY").otherwise("REVIEW_ONLY")
        return own.groupBy(kind.alias("involvement")).agg(F.sum("n").alias("vids"))


#: Rows that a range of ``number_by`` is meant for.
RANGE_ROWS = 500_000


def number_by(df: DataFrame, by: str, to: str) -> DataFrame:
    """Consecutive numbers from 1 in the order of ``by`` (distinct values).

    Rows are dealt into ranges by Spark's sampling; the ranges' counts, a row each, give each range's
    first number.
    """
    rows = cut(df, "numbered")
    ranges = max(1, rows.count() // RANGE_ROWS)
    dealt = cut(rows.repartitionByRange(ranges, by).withColumn("_p", F.spark_partition_id()), "ranges") if ranges > 1 else rows.withColumn("_p", F.lit(0))
    counts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    shift = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    within = Window.partitionBy("_p").orderBy(by)
    return dealt.withColumn("_r", F.row_number().over(within)).join(F.broadcast(shift), "_p").withColumn(to, (F.col("_r") + F.col("_s")).cast("long")).drop("_p", "_r", "_s")


def _organisation_classes(pairs: DataFrame, cfg: dict, display: bool = False, sizes: bool = False) -> DataFrame:
    """Classified pairs; ``sizes``: of groups, with their sizes."""
    w = cfg["org_review"]
    more = (rules.organisation_display() if display else {}) | ({f"n_{s}": F.col(f"{s}.n") for s in ("a", "b")} if sizes else {})
    return rules.classify(rules.organisation_signals(pairs), rules.organisation_rule(cfg), rules.organisation_score(cfg), w["review_threshold"], [(w["medium"], "Medium confidence"), (w["high_confidence"], "High confidence")], more=more)


def _person_classes(pairs: DataFrame, cfg: dict, shared: DataFrame | None, negatives: bool = True, display: bool = False) -> DataFrame:
    """Classified pairs; with ``display`` also both records' display columns, comment and rationale."""
    score = rules.person_score(cfg)
    more = rules.person_display() | rules.person_texts(cfg, score[0]) if display else None
    return _person_rules(rules.person_signals(pairs, shared), cfg, negatives, more)


def _person_rules(signals: DataFrame, cfg: dict, negatives: bool = True, more: dict | None = None) -> DataFrame:
    w = cfg["person_review"]
    tiers = [(w["medium"], "Medium confidence"), (w["medium_high"], "Medium-high confidence"), (w["high_confidence"], "High confidence")]
    return rules.classify(signals, rules.person_rule(cfg), rules.person_score(cfg), w["review_threshold"], tiers, rules.person_not_dup(cfg) if negatives else None, more)


def _read(canon: DataFrame, display: bool = False) -> DataFrame:
    """The columns that keys, signals and, with ``display``, reviewers read."""
    return canon.drop("status", "name_stripped", *[] if display else ["display_name", "display_type", "display_city"])


def _grouped_organisations(canon: DataFrame, cfg: dict, display: bool) -> Grouped:
    """Every block whole: like records meet as one, as a cap on ids would not allow."""
    groups, records = profiles.grouped(_read(canon, display))
    keys = blocking.organisation_keys(groups, cfg)
    own = keys.join(groups.where("n > 1").select("vid"), "vid", "left_semi").select(F.col("vid").alias("vid_a"), F.col("vid").alias("vid_b")).distinct()
    pairs = cut(blocking.candidate_pairs(keys, hot=HOT).unionByName(own), "pairs")
    classes = cut(_organisation_classes(rules.paired(pairs, groups), cfg, display, sizes=True), "classes")
    return Grouped(records, profiles.unrolled(classes, records), cfg["velocity_per_hour"], classes, records)


def dedupe_organisations(df: DataFrame, cfg: dict, display: bool = False) -> Linked:
    canon = rules.organisation_words(canonical.organisations(df, cfg))
    b = cfg["blocking"]
    if not b["cap"] and not b["max_pairs"]:
        return _grouped_organisations(canon, cfg, display)
    pairs = blocking.candidate_pairs(blocking.organisation_keys(canon, cfg), b["cap"], b["max_pairs"], HOT)
    return Linked(canon, _organisation_classes(rules.paired(pairs, canon), cfg, display), cfg["velocity_per_hour"])


def _numbered(canon: DataFrame, cfg: dict, shared: DataFrame) -> DataFrame:
    """Records as ``operators.tiles`` compares them, numbered from 0 in the order of their ids."""
    rows = cut(tiles.encoded(canon, blocking.person_keys(canon, cfg), cfg, shared), "encoded")
    return cut(rows.join(number_by(rows.select("vid"), "vid", "at").withColumn("at", F.col("at") - 1), "vid"), "numbered")


def _combined(rows: DataFrame, one: bool, cfg: dict, negatives: bool) -> tuple[list, DataFrame]:
    more = {c: F.col(c) for c in ("raw", "bits", "n")}
    return tiles.classified(rows, one, cfg, lambda signals: _person_rules(signals, cfg, negatives, more))


@dataclass
class Tiled(Linked):
    """The same, from records compared block by block (``operators.tiles``): counts do not need the pairs."""

    rows: DataFrame | None = None
    known: list | None = None
    classes: DataFrame | None = None

    def summary(self) -> DataFrame:
        kinds = sorted({r["classification"] for r in self.known})
        vids = tiles.involved(self.rows, self.known, kinds).groupBy("classification").agg(F.count("*").alias("vids"))
        counts = self.classes.groupBy("classification").agg(F.sum("n").alias("pairs")).join(vids, "classification")
        return counts.withColumn("hours", F.bround(F.col("vids") / F.lit(self.velocity), 1))

    def rule_counts(self) -> DataFrame:
        return self.classes.groupBy("classification", "rule").agg(F.sum("n").alias("pairs"))


def _tiled_persons(canon: DataFrame, cfg: dict) -> Tiled:
    rows = tiles.dealt(_numbered(canon, cfg, canonical.shared_contacts(canon, cfg["shared_contact_threshold"])))
    known, classes = _combined(rows, True, cfg, True)
    pairs = tiles.pairs(rows, known).join(F.broadcast(classes.drop("n")), "place").drop("place")
    return Tiled(canon, pairs, cfg["velocity_per_hour"], rows, known, classes)


def _probed(probe: DataFrame, known: DataFrame, cfg: dict, same_ids: bool) -> DataFrame:
    """``best_matches`` of all probes that share a key with a reference record; the others are clean."""
    shared = canonical.shared_contacts(known, cfg["shared_contact_threshold"])
    if not tiles.dense(blocking.person_keys(known, cfg)):
        pairs = blocking.probe_pairs(blocking.person_keys(probe, cfg), blocking.person_keys(known, cfg), same_ids=same_ids, hot=HOT)
        return best_matches(probe, _person_classes(rules.paired(pairs, probe, known), cfg, shared, negatives=False))
    rows = tiles.dealt(_numbered(probe, cfg, shared), _numbered(known, cfg, shared))
    combined, classes = _combined(rows, False, cfg, False)
    found = tiles.best(rows, combined, NOISE, same_ids)
    top = found.groupBy("vid_a").agg(F.sum("hits").alias("match_count"), F.min(F.struct((-F.col("auto")).alias("auto"), (-F.col("value")).alias("value"), "vid_b", "place")).alias("t"))
    chosen = top.select("vid_a", "match_count", "t.vid_b", "t.place").join(F.broadcast(classes), "place")
    return _verdicts(probe, chosen.select("vid_a", F.struct("vid_b", "classification", "rule", "score", "nscore").alias("m"), "match_count"))


def dedupe_persons(df: DataFrame, cfg: dict, synonyms: dict[str, list[str]] | None = None, display: bool = False) -> Linked:
    canon = canonical.persons(df, cfg, synonyms)
    b = cfg["blocking"]
    if not b["cap"] and not b["max_pairs"]:
        canon = cut(canon, "records")
        if not display and tiles.dense(blocking.person_keys(canon, cfg)):
            return _tiled_persons(canon, cfg)
    pairs = blocking.candidate_pairs(blocking.person_keys(canon, cfg), b["cap"], b["max_pairs"], HOT)
    shared = canonical.shared_contacts(canon, cfg["shared_contact_threshold"])
    return Linked(canon, _person_classes(rules.paired(pairs, canon), cfg, shared, display=display), cfg["velocity_per_hour"])


def cross_check_organisations(target: DataFrame, master: DataFrame, cfg: dict) -> DataFrame:
    """Classified pairs (target, master); master records that are targets themselves are left out."""
    left = canonical.organisations(target, cfg)
    right = canonical.organisations(master, cfg).join(left.select("vid"), "vid", "left_anti")
    (one, lefts), (other, rights) = (profiles.grouped(_read(rules.organisation_words(x))) for x in (left, right))
    # numbers of groups of either side may be equal
    pairs = cut(blocking.probe_pairs(blocking.organisation_keys(one, cfg), blocking.organisation_keys(other, cfg), same_ids=True, hot=HOT), "pairs")
    return profiles.unrolled(cut(_organisation_classes(rules.paired(pairs, one, other), cfg, sizes=True), "classes"), lefts, rights)


NOISE = 60


def best_matches(probe: DataFrame, classed: DataFrame) -> DataFrame:
    """One row a probe: verdict, number of matches, best match; AUTO by name, then REVIEW by score, ties by id."""
    hits = classed.where((F.col("nscore") >= NOISE) & (F.col("classification") != rules.NOT_DUP))
    auto = F.col("classification") == rules.AUTO
    strength = F.struct(auto.cast("int").alias("auto"), F.when(auto, F.col("nscore")).otherwise(F.col("score").cast("double")).alias("value"))
    best = hits.groupBy("vid_a").agg(F.count("*").alias("match_count"), F.max(strength).alias("_top"))
    first = hits.withColumn("_s", strength).join(best, "vid_a").where(F.col("_s") == F.col("_top"))
    chosen = first.groupBy("vid_a").agg(F.min(F.struct("vid_b", "classification", "rule", "score", "nscore")).alias("m"), F.first("match_count").alias("match_count"))
    return _verdicts(probe, chosen)


def _verdicts(probe: DataFrame, chosen: DataFrame) -> DataFrame:
    """Every probe with its match ``m`` in ``chosen``, if it has one."""
    out = probe.select(F.col("vid").alias("vid_a")).join(chosen, "vid_a", "left")
    verdict = F.when(F.col("m").isNull(), "CLEAN").when(F.col("m.classification") == rules.AUTO, "LIKELY_DUP").otherwise("POSSIBLE_MATCH")
    return out.select(F.col("vid_a").alias("vid"), verdict.alias("verdict"), F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce("m.vid_b", F.lit("")).alias("best_vid"), F.coalesce("m.score", F.lit(0)).alias("best_score"), F.coalesce("m.rule", F.lit("")).alias("best_rule"), F.coalesce("m.nscore", F.lit(0.0)).alias("best_name"))


def screen_persons(requests: DataFrame, reference: DataFrame, cfg: dict, synonyms: dict | None = None) -> DataFrame:
    """Pre-screen of new records against a reference: AUTO and REVIEW only, never NOT_DUP rules."""
    probe, known = (cut(canonical.persons(x, cfg, synonyms), "records") for x in (requests, reference))
    return _probed(probe, known, cfg, False)


def match_external(source: DataFrame, reference: DataFrame, cfg: dict, synonyms: dict | None = None) -> DataFrame:
    """An external list (no licences, ids that mean nothing) against a reference; sources without a name are left out."""
    named = source.withColumn("vid", F.concat(F.lit("src:"), F.col("vid"))).drop("license_number", "license_body", "license_status")
    probe = cut(canonical.persons(named, cfg, synonyms).where("name_canon <> ''"), "records")
    return _probed(probe, cut(canonical.persons(reference, cfg, synonyms), "records"), cfg, True)


def lookup(form: dict[str, str], reference: DataFrame, cfg: dict, synonyms: dict | None = None) -> DataFrame:
    """All matches of one filled form, best first."""
    spark = reference.sparkSession
    one = spark.range(1).select(F.lit("form").alias("vid"), *[F.lit(v).alias(k) for k, v in form.items()])
    # what the reference is read for more than once comes from a table: its records without the columns that no signal reads
    probe, known = (cut(canonical.persons(x, cfg, synonyms).drop("status", "display_name", "display_specialties"), "records") for x in (one, reference))
    keys = blocking.person_keys(known, cfg).join(F.broadcast(blocking.person_keys(probe, cfg).select("kind", "key")), ["kind", "key"], "left_semi")
    pairs = keys.select(F.lit("form").alias("vid_a"), F.col("vid").alias("vid_b")).where("vid_b <> 'form'").distinct()
    shared = canonical.shared_contacts(known, cfg["shared_contact_threshold"])
    classed = _person_classes(rules.paired(pairs, probe, known), cfg, shared, negatives=False)
    return classed.where((F.col("nscore") >= NOISE) & (F.col("classification") != rules.NOT_DUP)).orderBy(F.desc("score"), F.desc("nscore"), "vid_b")
