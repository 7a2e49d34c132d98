"""Every operator as a query over the synthetic tables, with DuckDB SQL for the same rows.

Documents stand for sequences (letters become bases), benchmark items and conversations for samples' reads;
events for ordered scores; line items, by supplier and month, for windows of samples; line items and orders
for intervals and annotation. All tables are read whole.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions import sequence as S
from .operators import annotation, attributes, cohort, compare, genotypes, ibs, kmers, rewindow, sitestats, windows
from .plans.screening import screen, screen_features
from .sources import fasta, gtf, wintable

K, WINDOW, STEP = 9, 200, 70
QUERIES, ORACLE_SQL = {}, {}

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_BASES = ("ACGT" * 7)[:26]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Sequences and k-mers


def sequences(spark: SparkSession, d: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return table(spark, d, name).select(F.col(key).alias("contig"), S.pseudo_sequence(F.col("text")).alias("seq"))


def benchmark_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmers.count_kmers(sequences(spark, d, "benchmark", "item_id"), K)


def _seq_sql(name: str, key: str, text: str = "text") -> str:
    mapped = f"translate(regexp_replace({text}, '[ \\n\\t\\r]', '', 'g'), '{_LETTERS + _LETTERS.upper()}', '{_BASES * 2}')"
    return f"(select {key} as contig, regexp_replace({mapped}, '[^ACGT]', 'N', 'g') as seq from {name})"


def _kmer_sql(name: str, key: str) -> str:
    rc = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
    return f"""(select contig, p, kmer, least(kmer, {rc}) as canon from (
        select contig, p, substr(seq, p + 1, {K}) as kmer from (select contig, seq, cast(unnest(range(0, greatest(length(seq) - {K - 1}, 0))) as int) as p from {_seq_sql(name, key)}))
        where not contains(kmer, 'N'))"""


_DOC_KMERS, _ITEM_KMERS = _kmer_sql("documents", "doc_id"), _kmer_sql("benchmark", "item_id")
_COUNTS = f"(select canon, count(*) as cnt from {_ITEM_KMERS} group by 1)"


@query(f"select contig, count(*) as n, min(p) as first_pos, max(p) as last_pos, cast(sum(p) as bigint) as pos_sum, min(kmer) as least_kmer from {_DOC_KMERS} group by 1")
def kmer_extract(spark, d):
    found = kmers.kmers(sequences(spark, d), K, packed=True)
    found = found.groupBy("contig").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("pos").alias("pos_sum"), F.min("kmer").alias("least_kmer"))
    return found.withColumn("least_kmer", S.unpack(F.col("least_kmer"), K))


@query(f"select canon as kmer, count(*) as cnt from {_DOC_KMERS} group by 1")
def kmer_count(spark, d):
    return kmers.count_kmers(sequences(spark, d), K)


@query(f"select canon as kmer, count(*) as cnt from {_ITEM_KMERS} group by 1 having count(*) between 2 and 9")
def min_count_filter(spark, d):
    return kmers.count_kmers(sequences(spark, d, "benchmark", "item_id"), K, min_count=2, max_count=9)


@query(f"""select distinct kmer, canon, {" + ".join(f"(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (K - 1 - i)}" for i in range(K))} as code, kmer as unpacked, substr(kmer, 1, 4) as pre, substr(kmer, 5) as suf from {_ITEM_KMERS}""")
def kmer_pack(spark, d):
    found = kmers.kmers(sequences(spark, d, "benchmark", "item_id"), K).select("kmer").distinct()
    code = S.pack(F.col("kmer"))
    return found.select("kmer", S.canonical(F.col("kmer")).alias("canon"), code.alias("code"), S.unpack(code, K).alias("unpacked"), S.prefix(F.col("kmer"), 4).alias("pre"), S.suffix(F.col("kmer"), K - 4).alias("suf"))


@query(f"select contig, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) as rc, md5(seq) as back from {_seq_sql('documents', 'doc_id')}")
def revcomp(spark, d):
    return sequences(spark, d).select("contig", F.md5(S.revcomp(F.col("seq"))).alias("rc"), F.md5(S.revcomp(S.revcomp(F.col("seq")))).alias("back"))


@query(f"select contig, cast(coalesce(list_sum(list_transform(list_filter(string_split_regex(seq, '[^ACGT]'), lambda r: length(r) >= {K}), lambda r: length(r))), 0) as int) as eff_len from {_seq_sql('documents', 'doc_id')}")
def eff_length(spark, d):
    return sequences(spark, d).select("contig", S.effective_length(F.col("seq"), K).alias("eff_len"))


@query(f"select distinct i.canon as kmer from {_ITEM_KMERS} i semi join {_kmer_sql('conversations', 'conv_id * 1000 + turn')} c using (canon)")
def kmer_exists(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("contig"), S.pseudo_sequence(F.col("text")).alias("seq"))
    return kmers.existing(benchmark_counts(spark, d).select("kmer"), kmers.count_kmers(turns, K))


@query(f"select canon as kmer from {_ITEM_KMERS} intersect select canon from {_DOC_KMERS}")
def kmer_intersect(spark, d):
    return kmers.common(benchmark_counts(spark, d), kmers.count_kmers(sequences(spark, d), K))


# Windows


_LENGTHS = f"(select contig, length(seq) as len from {_seq_sql('documents', 'doc_id')})"
_TILES = f"""(select contig, win, win * {WINDOW - K + 1} as st, least(win * {WINDOW - K + 1} + {WINDOW}, len) as en
    from (select contig, len, cast(unnest(range(0, cast(ceil(greatest(0, len - {WINDOW}) / {WINDOW - K + 1}.0) as bigint) + 1)) as int) as win from {_LENGTHS} where len >= {K}))"""
_SLIDES = f"""(select contig, win, win * {STEP} as st, least(win * {STEP} + {WINDOW}, len) as en
    from (select contig, len, cast(unnest(range(0, len)) as int) as win from {_LENGTHS} where len >= {K}) where win * {STEP} < len and least(win * {STEP} + {WINDOW}, len) - win * {STEP} >= {K})"""


def lengths(spark, d):
    return sequences(spark, d).select("contig", F.length("seq").alias("length"))


@query(f'select contig, win, st as "start", en as "end" from {_TILES}')
def window_tile(spark, d):
    return windows.tiles(lengths(spark, d), WINDOW, K)


@query(f'select contig, win, st as "start", en as "end" from {_SLIDES}')
def window_slide(spark, d):
    return windows.slides(lengths(spark, d), WINDOW, STEP, K)


def _fold_sql(wins: str, min_count: int, found: str = _DOC_KMERS, meets: str = f"v.contig = w.contig and v.p >= w.st and v.p + {K} <= w.en") -> str:
    """The fold with k-mers put into windows by a range join."""
    return f"""
        with v as materialized (select contig, p, canon from {found}), db as (select * from {_COUNTS}), w as (select * from {wins}),
        j as (select w.contig, w.win, v.p, coalesce(db.cnt, 0) as cnt from w join v on {meets} left join db using (canon)),
        o as (select *, row_number() over x as o, case when p - lag(p) over x = 1 then 0 else 1 end as brk from j window x as (partition by contig, win order by p)),
        h as (select *, max(case when cnt >= {min_count} then o end) over (partition by contig, win order by o rows between unbounded preceding and 1 preceding) as ph from o),
        g as (select *, o - coalesce(ph, 0) - 1 as gap from h),
        a as (select contig, win, count(*) as tot, count(*) filter (cnt >= {min_count}) as ob, count(*) filter (cnt >= {min_count} and gap > 0) as va0,
            coalesce(sum(case when gap - {K - 1} <= 0 then abs(gap - {K - 2}) else gap - {K - 1} end) filter (cnt >= {min_count} and gap > 0 and ph is not null), 0) as id,
            coalesce(min(o) filter (cnt >= {min_count}) - 1, 0) as ld, count(*) - coalesce(max(o) filter (cnt >= {min_count}), 0) as rd,
            coalesce(sum(cnt) filter (cnt >= {min_count}), 0) as kc, count(*) + {K - 1} * sum(brk) as eff from g group by 1, 2),
        z as (select w.contig, w.win, w.st as "start", w.en as "end", coalesce(tot, 0) as total_kmers, coalesce(ob, 0) as ob, coalesce(va0, 0) + cast(coalesce(rd, 0) > 0 as bigint) as va,
            cast(coalesce(id, 0) as bigint) as id, coalesce(ld, 0) as ld, coalesce(rd, 0) as rd, cast(coalesce(kc, 0) as bigint) as kmer_count, cast(coalesce(eff, 0) as bigint) as eff_len from w left join a using (contig, win))
        select *, case when ob > 0 then cast(kmer_count as double) / ob else 0.0::double end as kd, {_score_sql()} as score from z"""


def _score_sql(weights: tuple[float, float, float] = M.DEFAULT_WEIGHTS) -> str:
    wi, wt, wr = (f"cast({w} as double)" for w in weights)
    return f"case when ob > 0 and total_kmers > 0 and eff_len > 0 then ((({wr} * (cast(ob as double) / total_kmers)) + ({wi} * (1 - cast(id as double) / eff_len))) + ({wt} * (1 - cast(ld + rd as double) / eff_len))) * 100 else 0.0::double end"


@query(_fold_sql(_TILES, 1))
def window_fold(spark, d):
    return screen(sequences(spark, d), benchmark_counts(spark, d), K, WINDOW)


@query(_fold_sql(_SLIDES, 2))
def window_fold_slide(spark, d):
    return screen(sequences(spark, d), benchmark_counts(spark, d), K, WINDOW, STEP, min_count=2)


# Ordered scores


def scored_events(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("sample"), F.col("user_id").alias("chrom"), F.struct("ts", "event_id").alias("win_ord"), F.col("event_id").alias("start"), (F.col("event_id") + 10).alias("end"), F.col("event_id").alias("win_id"), F.col("value").alias("score"))


def _region_sql(meets: str, gap: int) -> str:
    return f"""
        with e as (select event_type as sample, user_id as chrom, event_id, value as score, row_number() over (partition by event_type, user_id order by ts, event_id) as rn, {meets} as m from events),
        p as (select *, max(case when m then rn end) over (partition by sample, chrom order by rn rows between unbounded preceding and 1 preceding) as prv from e),
        f as (select *, case when m and (prv is null or rn - prv - 1 > {gap}) then 1 else 0 end as flag from p),
        s as (select *, cast(sum(flag) over (partition by sample order by chrom, rn rows unbounded preceding) as bigint) as seg, sum(flag) over (partition by sample, chrom order by rn rows unbounded preceding) as run from f),
        r as (select *, case when m then seg else -1 end as ibs, min(case when m then rn end) over (partition by sample, chrom, run) as lo, max(case when m then rn end) over (partition by sample, chrom, run) as hi from s)"""


_IBS, _VAR = _region_sql("value >= 40", 2), _region_sql("value < 40", 4)


@query(f"{_IBS} select sample, chrom, event_id as win_id, ibs from r")
def find_ibs(spark, d):
    return ibs.label_regions(scored_events(spark, d), cut=40, max_gap=2).select("sample", "chrom", "win_id", F.col("ibs").cast("long").alias("ibs"))


@query(f"{_VAR} select sample, chrom, event_id as win_id, ibs from r")
def find_var(spark, d):
    return ibs.label_regions(scored_events(spark, d), cut=40, max_gap=4, variable=True).select("sample", "chrom", "win_id", F.col("ibs").cast("long").alias("ibs"))


@query(f"""{_IBS} select sample, chrom, seg as block, min(event_id) as "start", max(event_id) + 10 as "end", max(event_id) + 10 - min(event_id) as length, count(*) as total_blocks,
    count(*) filter (m) as ibs_blocks, count(*) filter (m) / count(*) as ibs_proportion, cast(round(sum(score) * 100) as bigint) as score_cents from r where lo is not null and rn between lo and hi group by 1, 2, 3""")
def ibs_summary(spark, d):
    found = ibs.summarize_regions(ibs.label_regions(scored_events(spark, d), cut=40, max_gap=2))
    # Scores have two decimals: their sum is whole cents, whatever the order of summing.
    return found.withColumn("score_cents", F.round(F.col("mean_score") * F.col("total_blocks") * 100).cast("long")).drop("mean_score")


@query(f'{_IBS} select sample, chrom, event_id as "start", event_id + 10 as "end" from r where ibs > 0')
def ibs_bed(spark, d):
    return ibs.region_bed(ibs.label_regions(scored_events(spark, d), cut=40, max_gap=2))


# Windows of samples


_FACTS = """(select l_suppkey as chrom, month as win_ord, l_suppkey || '_' || month as win_id, month * 100 as "start", month * 100 + 100 as "end", l_returnflag as sample,
    n * 50 as total_kmers, q as ob, n as va, n * 2 as id, lo as ld, hi as rd, n * 50 + 8 as eff_len, nums as kmer_count, cast(nums as double) / q as kd, -1 as ibs
    from (select l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) as month, l_returnflag, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as q, cast(min(l_quantity) as bigint) as lo, cast(max(l_quantity) as bigint) as hi, cast(sum(l_linenumber) as bigint) as nums from lineitem group by 1, 2, 3))"""


def facts(spark, d):
    """Each supplier's months as windows, return flags as samples."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    g = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("chrom"), month.alias("win_ord"), F.col("l_returnflag").alias("sample")).agg(
        F.count("*").alias("va"), F.sum(F.col("l_quantity").cast("long")).alias("ob"), F.min("l_quantity").cast("long").alias("ld"), F.max("l_quantity").cast("long").alias("rd"), F.sum("l_linenumber").alias("kmer_count")
    )
    g = g.withColumns({"win_id": F.concat_ws("_", F.col("chrom").cast("string"), F.col("win_ord").cast("string")), "start": F.col("win_ord") * 100, "end": F.col("win_ord") * 100 + 100, "total_kmers": F.col("va") * 50, "id": F.col("va") * 2, "eff_len": F.col("va") * 50 + 8, "ibs": F.lit(-1)})
    return rewindow.rescore(g.withColumn("kd", M.mean_depth(F.col("kmer_count"), F.col("ob"))))


_SCORED = f"(select *, {_score_sql()} as score from {_FACTS})"
_A, _B, _N = 80, 76, 70
_CALLED = f"(select *, case when score >= {_A} then 0 when score >= {_B} then 2 when score <= {_N} then -1 else 1 end as allele from {_SCORED})"


def called(spark, d):
    return genotypes.call_alleles(facts(spark, d), _A, _B, _N)


@query(f"select chrom, win_id, sample, score from {_SCORED}")
def identity_score(spark, d):
    return facts(spark, d).select("chrom", "win_id", "sample", "score")


@query(f"select chrom, win_id, sample, kd, case when ld - 8 > 0 then ld - 8 else abs(ld - 7) end as gap from {_FACTS}")
def mean_depth(spark, d):
    return facts(spark, d).select("chrom", "win_id", "sample", "kd", M.gap_distance(F.col("ld"), K).alias("gap"))


@query(f"select chrom, win_id, sample, {_score_sql((0.5, 0.2, 0.3))} as score from {_FACTS}")
def score_recalc(spark, d):
    return rewindow.rescore(facts(spark, d), (0.5, 0.2, 0.3)).select("chrom", "win_id", "sample", "score")


@query(f"""select chrom, win_id, min(score) as min_score, max(score) as max_score, round(sum(score) / count(*), 4) as mean_score, min(ob) as min_ob, max(ob) as max_ob, cast(avg(ob) as float) as mean_ob,
    min(va) as min_va, max(va) as max_va, cast(avg(va) as float) as mean_va from {_SCORED} group by 1, 2""")
def info_stats(spark, d):
    return cohort.window_stats(facts(spark, d)).withColumn("mean_score", F.round("mean_score", 4))


@query(f"select chrom, win_id, sample, case sample when 'A' then 0 when 'N' then 1 else 2 end as sample_idx, ob, va from {_FACTS}")
def cohort_merge(spark, d):
    rows, names = facts(spark, d), ["A", "N", "R"]
    merged = cohort.align(cohort.merge([rows.where(F.col("sample") == s) for s in names]), names)
    return merged.select("chrom", "win_id", "sample", "sample_idx", "ob", "va")


@query(f"select chrom, win_id, 'missing' as problem from {_FACTS} group by 1, 2 having count(*) < (select count(distinct l_returnflag) from lineitem)")
def cohort_validate(spark, d):
    return cohort.validate(facts(spark, d))


@query(f"""select win_id as window_id, max(score) filter (sample = 'A') as "A", max(score) filter (sample = 'N') as "N", max(score) filter (sample = 'R') as "R" from {_SCORED} group by 1""")
def attributes_wide(spark, d):
    return attributes.attribute_table(facts(spark, d), "score", ["A", "N", "R"])


@query(f"""select win_id as window_id, max(ld + rd) filter (sample = 'A') as "A", max(ld + rd) filter (sample = 'N') as "N", max(ld + rd) filter (sample = 'R') as "R" from {_FACTS} group by 1""")
def attributes_tails(spark, d):
    return attributes.attribute_table(facts(spark, d), "tailDist", ["A", "N", "R"])


@query(f"""select sample, win_id as window_id, chrom as seqname, "start", "end", eff_len, total_kmers, ob as observed_kmers, va as variations, id + ld + rd as kmer_distance, kd as mean_kmer_depth, score from {_SCORED}""")
def sample_tsv(spark, d):
    return attributes.sample_table(facts(spark, d))


@query(f"""with b as (select *, cast(floor((row_number() over (partition by sample, chrom order by win_ord) - 1) / 6) as bigint) as bucket from {_FACTS}),
    l as (select *, lag(rd) over (partition by sample, chrom, bucket order by win_ord) as prv from b),
    g as (select sample, chrom, bucket, min("start") as "start", max("end") as "end", cast(sum(total_kmers) as bigint) as total_kmers, cast(sum(ob) as bigint) as ob, cast(sum(va) as bigint) - count(*) filter (coalesce(prv, 0) > 0 and ld > 0 and va > 0) as va,
        cast(sum(id + ld + rd) as bigint) as s, arg_min(ld, win_ord) as ld, arg_max(rd, win_ord) as rd,
        cast(list_reduce(list_prepend(0.0::double, list(kd * ob order by win_ord)), lambda a, x: trunc(a + x)) as bigint) as kmer_count from l group by 1, 2, 3),
    r as (select *, s - ld - rd as id, "end" - "start" as eff_len, cast(kmer_count as double) / ob as kd from g)
    select sample, chrom, "start", "end", total_kmers, ob, va, ld, rd, id, eff_len, kmer_count, kd, {_score_sql()} as score from r""")
def increase_window(spark, d):
    out = rewindow.widen(facts(spark, d), rewindow.bucket_size(100, 500))
    return out.select("sample", "chrom", "start", "end", "total_kmers", "ob", "va", "ld", "rd", "id", "eff_len", "kmer_count", "kd", "score")


@query(f"select chrom, count(*) as cells, count(distinct win_id) as wins from {_FACTS} group by 1")
def split_chrom_counts(spark, d):
    return facts(spark, d).groupBy("chrom").agg(F.count("*").alias("cells"), F.count_distinct("win_id").alias("wins"))


# Alleles


_TALLY = f"(select chrom, win_id, count(*) filter (allele = 0) as c0, count(*) filter (allele = 1) as c1, count(*) filter (allele = 2) as c2, count(*) filter (allele = -1) as cn, count(*) as n from {_CALLED} group by 1, 2)"
_BAD = f"""(select chrom, win_id from {_TALLY} where greatest(c0, c1, c2, cn) = n or (n - cn > 0 and (c0 <= cast(0.05 as double) * (n - cn) or c2 <= cast(0.05 as double) * (n - cn))) or cn >= cast(0.8 as double) * n or cn + c1 >= cast(0.8 as double) * n)"""
_CONTIGS = f"(select chrom, cast(row_number() over (order by m, chrom) as int) as contig_id from (select chrom, min(win_ord) as m from {_FACTS} group by 1))"
_GOOD = f"(select c.*, i.contig_id from {_CALLED} c anti join {_BAD} b using (chrom, win_id) join {_CONTIGS} i using (chrom))"


def good(spark, d):
    marked = genotypes.good_markers(called(spark, d))
    return marked.join(genotypes.contig_map(facts(spark, d)), "chrom")


@query(f"select chrom, win_id, sample, allele, case allele when 0 then 'A A' when 2 then 'G G' when 1 then 'A G' else '0 0' end as gt from {_CALLED}")
def allele_call(spark, d):
    return called(spark, d).select("chrom", "win_id", "sample", "allele", M.genotype(F.col("allele")).alias("gt"))


@query(f"select chrom, win_id, c0, c1, c2, cn, n as samples from {_TALLY}")
def allele_counts(spark, d):
    return genotypes.allele_counts(called(spark, d))


@query(f"select * from {_BAD}")
def bad_window_filter(spark, d):
    return genotypes.bad_windows(called(spark, d))


@query(f"select * from {_CONTIGS}")
def contig_map(spark, d):
    return genotypes.contig_map(facts(spark, d))


@query(f"""select win_id as "ID", contig_id as "CHR", "start" as "START", "end" as "END", coalesce(max(allele) filter (sample = 'A'), -1) as "A", coalesce(max(allele) filter (sample = 'N'), -1) as "N", coalesce(max(allele) filter (sample = 'R'), -1) as "R" from {_GOOD} group by 1, 2, 3, 4""")
def genotype_table(spark, d):
    return genotypes.genotype_table(good(spark, d), ["A", "N", "R"])


@query(f"select sample, string_agg(case allele when 0 then 'A' || chr(9) || 'A' when 2 then 'G' || chr(9) || 'G' when 1 then 'A' || chr(9) || 'G' else '0' || chr(9) || '0' end, chr(9) order by contig_id, win_ord) as genotypes from {_GOOD} group by 1")
def plink_ped(spark, d):
    return genotypes.ped(good(spark, d).withColumn("win_ord", F.struct("contig_id", "win_ord")))


@query(f"""select contig_id, cast(row_number() over (order by contig_id, win_ord) - 1 as bigint) as marker, 0 as zero, "start" from (select distinct contig_id, win_ord, "start" from {_GOOD})""")
def plink_map(spark, d):
    return genotypes.marker_map(good(spark, d)).withColumn("marker", F.col("marker").cast("long"))


@query(f"select sample, string_agg(cast(case when allele = -1 then 1 else allele end as varchar), chr(9) order by contig_id, win_ord) as codes from {_GOOD} group by 1")
def matrix(spark, d):
    return genotypes.matrix(good(spark, d).withColumn("win_ord", F.struct("contig_id", "win_ord")))


@query("""select l_orderkey, l_linenumber, l_partkey, l_returnflag || '/' || l_linestatus as alleles, l_shipinstr as call,
    case when l_shipinstr = l_returnflag then 0 when l_shipinstr = l_linestatus then 2 when l_shipinstr = 'N' then -1 else 1 end as code
    from (select *, substr('ANRFO', cast(l_partkey % 5 as int) + 1, 1) as l_shipinstr from lineitem)""")
def hapmap_recode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("/", "l_returnflag", "l_linestatus").alias("alleles"), F.expr("substring('ANRFO', cast(l_partkey % 5 as int) + 1, 1)").alias("call"))
    return rows.withColumn("code", M.hapmap_code(F.col("call"), F.col("alleles")))


# Statistics


@query(f"""select chrom, win_id, round(least(f, 1 - f), 3) as maf, round(cast(cn as double) / n, 3) as miss, round(case when n - cn > 0 then cast(c1 as double) / (n - cn) end, 3) as het
    from (select *, case when n - cn > 0 then cast(c2 * 2 + c1 as double) / ((n - cn) * 2) end as f from {_TALLY})""")
def site_summary(spark, d):
    return sitestats.site_summary(called(spark, d))


@query(f"select * from ({ORACLE_SQL['site_summary']}) where maf >= cast(0.1 as double) and miss <= cast(0.5 as double) and het <= cast(0.9 as double)")
def kept_markers(spark, d):
    return sitestats.keep_markers(sitestats.site_summary(called(spark, d)), 0.1, 0.5, 0.9)


@query(f"select chrom, win_id from {_CALLED} group by 1, 2 having count(distinct allele) > 1")
def polymorphic_sites(spark, d):
    return sitestats.polymorphic(called(spark, d))


@query("""with g as (select l_suppkey as marker, l_linenumber as sample, cast(count(*) % 3 as double) as g from lineitem group by 1, 2),
    full_ as (select * from g where marker in (select marker from g group by 1 having count(*) = (select count(distinct l_linenumber) from lineitem))),
    m as (select marker, avg(g) as mean from full_ group by 1 having avg(g) > 0 and avg(g) < 2), k as (select f.*, mean from full_ f join m using (marker)),
    i as (select 1 - min(fi) as inb from (select sum(1 - abs(g - 1)) / (2 * count(*)) as fi from k group by sample)),
    p as (select x.sample as a, y.sample as b, sum((x.g - x.mean) * (y.g - y.mean)) as v from k x join k y using (marker) group by 1, 2),
    l as (select min(v) filter (a = b) as dl, max(v) filter (a = b) as du, min(v) as low from p),
    s as (select a, b, (1 + inb) * (v - low) / (du - low) as v, (1 + inb) * (dl - low) / (du - low) as dmin, 1 + inb as top from p, l, i),
    t as (select a, b, top, case when dmin >= 1 then v when a = b then (v - dmin + 1) / ((top + 1 - dmin) * 0.5) else v / dmin end as v from s)
    select a, b, round(case when a <> b and o > top then v * top / o else v end, 6) as k from t, (select max(v) filter (a <> b) as o from t)""")
def kinship(spark, d):
    rows = table(spark, d, "lineitem")
    g = rows.groupBy(F.col("l_suppkey").alias("marker"), F.col("l_linenumber").alias("sample")).agg((F.count("*") % 3).alias("g"))
    n = rows.agg(F.count_distinct("l_linenumber").alias("n"))
    whole = g.groupBy("marker").agg(F.count("*").alias("have")).crossJoin(F.broadcast(n)).where("have = n").select("marker")  # one row
    return sitestats.kinship(g.join(whole, "marker", "left_semi")).withColumn("k", F.round("k", 6))


_LEN = "(select l_suppkey as chr, cast(max(l_partkey) * 1000 as bigint) as len from lineitem group by 1)"


def chrom_lengths(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("chr")).agg((F.max("l_partkey") * 1000).alias("len"))


@query(f"select chr, len, cast(sum(len) over (order by chr) - len as bigint) as \"offset\", cast(sum(len) over (order by chr) - len + len / 2.0 as double) as mid from {_LEN}")
def chrom_cumulative(spark, d):
    return sitestats.chromosome_offsets(chrom_lengths(spark, d))


@query(f"select chr, i * 500000 / 1e6 as pos from (select chr, unnest(range(0, cast(floor(len / 500000.0) as bigint) + 1)) as i from {_LEN})")
def position_grid(spark, d):
    return sitestats.position_grid(chrom_lengths(spark, d))


_HITS = "(select l_suppkey as chr, l_partkey * 1000 as \"start\", l_quantity * l_quantity * l_quantity * l_quantity / 1e12 as pval from lineitem)"


def hits(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chr"), (F.col("l_partkey") * 1000).alias("start"), (F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") * F.col("l_quantity") / F.lit(1e12)).alias("pval"))


@query(f"select distinct chr, pos, pval from (select *, rank() over (partition by chr, pos order by pval) as r from (select *, round_even(\"start\" / 500000.0, 0) / 2 as pos from {_HITS})) where r = 1")
def best_hit_per_bin(spark, d):
    return sitestats.best_per_bin(hits(spark, d))


@query(f"select chr, \"start\", pval, round(-log10(pval), 9) as logp from {_HITS} where -log10(pval) >= -log10(0.05 / (select count(*) from lineitem))")
def significant_hits(spark, d):
    return sitestats.significant(hits(spark, d)).withColumn("logp", F.round("logp", 9))


@query("""select sample, grp, cast(row_number() over (order by o, sample) as int) as position from (select distinct c_name as sample, c_mktsegment as grp, dense_rank() over (order by c_mktsegment desc) as o from customer)""")
def sample_positions(spark, d):
    c = table(spark, d, "customer")
    groups = c.select("c_mktsegment").distinct().withColumn("grp_order", F.row_number().over(_by_desc("c_mktsegment")))
    s = c.select(F.col("c_name").alias("sample"), F.col("c_mktsegment").alias("grp")).distinct().join(groups, F.col("grp") == F.col("c_mktsegment"))
    return sitestats.sample_positions(c.select(F.col("c_name").alias("sample")), s.select("sample", "grp", "grp_order"))


def _by_desc(column):
    from pyspark.sql import Window

    return Window.orderBy(F.col(column).desc())


@query(f"select cast(least(floor(score / 2), 49) as bigint) as bin, count(*) as n from {_SCORED} group by 1")
def score_histogram(spark, d):
    return sitestats.histogram(facts(spark, d))


# Intervals and annotation


_LOCI = "(select l_suppkey as chrom, l_linestatus as strand, cast(datediff('day', date '1970-01-01', cast(l_shipdate as date)) as int) as s, cast(datediff('day', date '1970-01-01', cast(l_shipdate as date)) + l_quantity as int) as e from lineitem)"


def loci(spark, d):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("chrom"), F.col("l_linestatus").alias("strand"), day.alias("start"), (day + F.col("l_quantity").cast("int")).alias("end"))


@query(f"""with r as (select *, max(e) over (partition by chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from {_LOCI}),
    i as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by chrom, strand order by s, e rows unbounded preceding) as island from r)
    select chrom, strand, min(s) as "start", max(e) as "end" from i group by chrom, strand, island""")
def interval_merge(spark, d):
    return annotation.merge_intervals(loci(spark, d), [])


_ORDER_SPANS = "(select o_custkey % (select max(s_suppkey) from supplier) + 1 as chrom, cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as int) as s, cast(datediff('day', date '1970-01-01', cast(o_orderdate as date)) as int) + 30 as e from orders)"


def order_spans(spark, d):
    most = table(spark, d, "supplier").agg(F.max("s_suppkey").alias("m"))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    return table(spark, d, "orders").crossJoin(F.broadcast(most)).select((F.col("o_custkey") % F.col("m") + 1).alias("chrom"), day.alias("start"), (day + 30).alias("end"))  # one row


@query(f'select chrom, strand, s as "start", e as "end" from {_LOCI} l where exists (select 1 from {_ORDER_SPANS} o where o.chrom = l.chrom and l.s >= o.s and l.e <= o.e)')
def interval_contained(spark, d):
    return annotation.contained(loci(spark, d), order_spans(spark, d)).select("chrom", "strand", "start", "end")


@query(f'select chrom, strand, s as "start", e as "end" from {_LOCI} l where not exists (select 1 from {_ORDER_SPANS} o where o.chrom = l.chrom and l.s <= o.e and o.s <= l.e)')
def interval_disjoint(spark, d):
    return annotation.not_overlapping(loci(spark, d), order_spans(spark, d)).select("chrom", "strand", "start", "end")


_EXONS = """(select 'x' || l_orderkey % (select count(*) from documents) as chrom, 'exon' as type, cast(l_partkey % 200 + 1 as int) as s, cast(l_partkey % 200 + 1 + l_quantity as int) as e, l_linestatus as strand,
    'g' || o_custkey as gene_id, 't' || l_orderkey as transcript_id, l_orderkey * 1000000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as line_no from lineitem join orders on o_orderkey = l_orderkey)"""


def records(spark, d):
    """Orders as transcripts of their customers' genes, line items as exons; chromosomes are documents."""
    from pyspark.sql import Window

    docs = table(spark, d, "documents").agg(F.count("*").alias("n"))
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).crossJoin(F.broadcast(docs))  # one row
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    start = (F.col("l_partkey") % 200 + 1).cast("int")
    exons = li.select(
        F.concat(F.lit("x"), (F.col("l_orderkey") % F.col("n")).cast("string")).alias("chrom"), F.lit("exon").alias("type"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"), F.col("l_linestatus").alias("strand"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("gene_id"), F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("transcript_id"), (F.col("l_orderkey") * 1000000 + at).alias("line_no"),
    )
    tx = exons.groupBy("transcript_id").agg(F.first("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.first("gene_id").alias("gene_id"), (F.min("line_no") - 1).alias("line_no"))
    return exons.unionByName(tx.withColumn("type", F.lit("mRNA")))


_TX = f"(select transcript_id, gene_id, any_value(chrom) as chrom, min(s) as s, max(e) as e, min(strand) as strand, min(line_no) - 1 as line_no from {_EXONS} group by 1, 2)"


@query(f"""select 'gene' as kind, gene_id as id, arg_min(chrom, line_no) as parent, arg_min(chrom, line_no) as chrom, min(s) as "start", max(e) as "end", arg_min(strand, line_no) as strand from {_TX} group by gene_id
    union all select 'transcript', transcript_id, gene_id, chrom, s, e, strand from {_TX}
    union all select 'exon', transcript_id || '-e-' || row_number() over (partition by transcript_id order by line_no), transcript_id, chrom, s, e, strand from {_EXONS}""")
def gtf_tree(spark, d):
    return annotation.features(records(spark, d)).drop("line_no")


@query(f"select distinct arg_min(chrom, line_no) as chrom from {_TX} group by gene_id")
def gtf_roots(spark, d):
    return annotation.roots(annotation.features(records(spark, d)))


def _merged_sql(owner: str) -> str:
    """Distinct exons of each owner, merged."""
    return f"""(with x as (select distinct {owner} as owner, chrom, s, e, strand from {_EXONS}),
    r as (select *, max(e) over (partition by owner, chrom, strand order by s, e rows between unbounded preceding and 1 preceding) as reach from x),
    i as (select *, sum(case when s <= reach then 0 else 1 end) over (partition by owner, chrom, strand order by s, e rows unbounded preceding) as island from r)
    select owner, chrom, min(s) as s, max(e) as e from i group by owner, chrom, strand, island)"""


def _spliced_sql(owner: str) -> str:
    return f"select owner, chrom, string_agg(substr(seq, s, e - s + 1), '' order by s, substr(seq, s, e - s + 1)) as seq from {_merged_sql(owner)} m join {_seq_sql('documents', 'doc_id')} q on m.chrom = 'x' || q.contig group by 1, 2"


def _screen_sql(owner: str, feats: str) -> str:
    """The fold over spliced sequences of feats (contig, win, st, en)."""
    cut = f"(select owner as contig, p, kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) as canon from (select owner, p, substr(seq, p + 1, {K}) as kmer from (select owner, seq, cast(unnest(range(0, greatest(length(seq) - {K - 1}, 0))) as int) as p from ({_spliced_sql(owner)}))) where not contains(kmer, 'N'))"
    return _fold_sql(feats, 1, cut, "v.contig = w.win")


def doc_contigs(spark, d):
    return sequences(spark, d).select(F.concat(F.lit("x"), F.col("contig").cast("string")).alias("contig"), "seq")


@query(f"select owner, chrom, md5(seq) as seq from ({_spliced_sql('transcript_id')})")
def spliced_seq(spark, d):
    return annotation.spliced(annotation.features(records(spark, d)), doc_contigs(spark, d), False).withColumn("seq", F.md5("seq"))


@query(_screen_sql("transcript_id", f"(select chrom as contig, transcript_id as win, s as st, e as en from {_TX})"))
def screen_transcripts(spark, d):
    return screen_features(annotation.features(records(spark, d)), doc_contigs(spark, d), benchmark_counts(spark, d), K, "transcript")


# Each order is a gene here, so that a gene lies on one chromosome; those of even number have a record of their own, in
# the middle of their lines.
_ORDER_GENES = f"""(select gene_id, chrom, case when own and not late then 30 when own then least(30, s) else s end as st, case when own and not late then 40 when own then greatest(40, e) else e end as en, case when own then '.' else strand end as strand, own
    from (select 'G' || substr(transcript_id, 2) as gene_id, chrom, s, e, strand, cast(substr(transcript_id, 2) as bigint) % 2 = 0 as own, cast(substr(transcript_id, 2) as bigint) % 4 = 0 as late from {_TX}))"""


def order_genes(spark, d):
    """records(), where every order is a gene; of four, one has a record before its transcript, one after it."""
    number = F.substring("transcript_id", 2, 20).cast("long")
    rows = records(spark, d).withColumn("gene_id", F.concat(F.lit("G"), F.substring("transcript_id", 2, 20)))
    own = rows.where((F.col("type") == "mRNA") & (number % 2 == 0))
    own = own.withColumns({"type": F.lit("gene"), "start": F.lit(30), "end": F.lit(40), "strand": F.lit("."), "line_no": F.col("line_no") + F.when(number % 4 == 0, -1).otherwise(500_000), "transcript_id": F.lit(None).cast("string")})
    return annotation.features(rows.unionByName(own))


@query(f"""select 'gene' as kind, gene_id as id, chrom as parent, chrom, st as "start", en as "end", strand from {_ORDER_GENES}""")
def gene_records(spark, d):
    return order_genes(spark, d).where("kind = 'gene'").drop("line_no")


@query(f"select gene_id as id, cast(substr(gene_id, 2) as bigint) as number from {_ORDER_GENES} where own")
def gene_children(spark, d):
    feats = order_genes(spark, d)
    genes = feats.where("kind = 'gene'").select("id", F.substring("id", 2, 20).cast("long").alias("number")).where("number % 2 = 0")
    found = annotation.children(feats.where("kind = 'transcript'"), genes)
    return found.select(F.col("parent").alias("id"), F.substring("id", 2, 20).cast("long").alias("number"))


@query(f"select owner, chrom, md5(seq) as seq from ({_spliced_sql('gene_id')})")
def spliced_genes(spark, d):
    return annotation.spliced(annotation.features(records(spark, d)), doc_contigs(spark, d), True).withColumn("seq", F.md5("seq"))


@query(_screen_sql("'G' || substr(transcript_id, 2)", f"(select chrom as contig, gene_id as win, st, en from {_ORDER_GENES})"))
def screen_genes(spark, d):
    return screen_features(order_genes(spark, d), doc_contigs(spark, d), benchmark_counts(spark, d), K)


@query(f"""with o as (select 'x' as sample, role as region_one, canon from (select role, k.canon from {_kmer_sql('conversations', 'conv_id * 1000 + turn')} k join conversations c on k.contig = c.conv_id * 1000 + c.turn)),
    t as (select 'x' as sample, contig as region_two, canon from {_ITEM_KMERS}), known as (select distinct canon from {_DOC_KMERS}),
    so as (select sample, region_one, count(*) as kmers_one from o group by 1, 2), st as (select sample, region_two, count(*) as kmers_two from t group by 1, 2),
    m as (select a.sample, region_one, region_two, count(*) as common, count(*) filter (canon in (select canon from known)) as known from (select distinct * from o) a join (select distinct * from t) b using (sample, canon) group by 1, 2, 3)
    select sample, region_one, region_two, kmers_one, kmers_two, coalesce(common, 0) as common, coalesce(known, 0) as known from so join st using (sample) left join m using (sample, region_one, region_two)""")
def compare_ibs(spark, d):
    turns = table(spark, d, "conversations").select(F.struct("role", "conv_id", "turn").alias("contig"), S.pseudo_sequence(F.col("text")).alias("seq"))
    one = kmers.kmers(turns, K, True, packed=True).select(F.lit("x").alias("sample"), F.col("contig.role").alias("region"), "kmer")
    two = kmers.kmers(sequences(spark, d, "benchmark", "item_id"), K, True, packed=True).select(F.lit("x").alias("sample"), F.col("contig").alias("region"), "kmer")
    return compare.compare_regions(one, two, kmers.count_kmers(sequences(spark, d), K, packed=True))


# Files: written to the shared folder and read again


def _new_file(spark: SparkSession, kind: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder or tempfile.mkdtemp()}/{kind}-{uuid.uuid4().hex}"


def _written_fasta(spark: SparkSession, d: str) -> str:
    path = _new_file(spark, "fasta")
    fasta.write_fasta(sequences(spark, d).where(F.length("seq") > 0).select(F.concat(F.lit("d"), "contig").alias("contig"), "seq", F.col("contig").alias("ord")), path)
    return path


_FASTA = f"(select 'd' || contig as contig, seq, length(seq) as len, cast(row_number() over (order by contig) as int) - 1 as idx from {_seq_sql('documents', 'doc_id')} where length(seq) > 0)"


@query(f"select idx as contig_idx, contig, '' as description, len as length, md5(seq) as seq from {_FASTA}")
def fasta_round_trip(spark, d):
    return fasta.read_fasta(spark, _written_fasta(spark, d)).withColumn("seq", F.md5("seq"))


@query(f"""with f as (select *, cast(ceil(len / 60.0) as int) as lines from {_FASTA}), o as (select *, sum(length(contig) + 2 + len + lines) over (order by idx rows between unbounded preceding and 1 preceding) as before from f)
    select contig as name, len as length, cast(coalesce(before, 0) + length(contig) + 2 as bigint) as "offset", least(len, 60) as line_bases, least(len, 60) + 1 as line_width from o""")
def fasta_index(spark, d):
    return fasta.fasta_index(spark, _written_fasta(spark, d)).select("name", "length", F.col("offset").cast("long").alias("offset"), "line_bases", "line_width")


@query(f"select contig, idx % 7 as \"start\", least(50, len - idx % 7) as length, substr(seq, idx % 7 + 1, least(50, len - idx % 7)) as seq from {_FASTA} where len > 20")
def fasta_ranges(spark, d):
    contigs = fasta.read_fasta(spark, _written_fasta(spark, d))
    at = F.col("contig_idx") % 7
    return fasta.fetch(contigs, contigs.where("length > 20").select("contig", at.alias("start"), F.least(F.lit(50), F.col("length") - at).alias("length")))


@query(f"""select chrom, case kind when 'transcript' then 'mRNA' else kind end as type, "start", "end", strand, case kind when 'gene' then id when 'transcript' then parent end as gene_id, case kind when 'transcript' then id when 'exon' then parent end as transcript_id
    from ({ORACLE_SQL['gtf_tree']})""")
def gtf_round_trip(spark, d):
    path = _new_file(spark, "gtf")
    gtf.write_gtf(annotation.features(records(spark, d)), path)
    found = gtf.read_gtf(spark, path).drop("line_no")
    return found.withColumn("type", F.when(F.col("type") == "transcript", "mRNA").otherwise(F.col("type")))


_WHOLE = f"""(select * replace (cast(sum(total_kmers) over w as bigint) as total_kmers, cast(sum(total_kmers) over w as bigint) + 8 as eff_len), count(*) over w as flags
    from {_FACTS} window w as (partition by win_id) qualify flags = 3)"""


def _written_windows(spark: SparkSession, d: str) -> str:
    """Windows with a cell for each return flag, as text; k-mers are those of the window, alike in all its cells."""
    rows, path = facts(spark, d), _new_file(spark, "windows")
    whole = rows.groupBy("win_id").agg(F.count("*").alias("flags"), F.sum("total_kmers").alias("total_kmers")).where("flags = 3").drop("flags").withColumn("eff_len", F.col("total_kmers") + 8)
    rows = rewindow.rescore(rows.drop("total_kmers", "eff_len").join(whole, "win_id"))
    chroms = [r.chrom for r in table(spark, d, "supplier").select(F.col("s_suppkey").alias("chrom")).orderBy("chrom").collect()]
    head = wintable.Header("orders.fa", {str(c): 10 * c for c in chroms}, {"window": "100", "kmer": str(K)}, ["query"], ["A", "N", "R"])
    wintable.write_windows(cohort.align(rows, head.samples).withColumn("chrom", F.col("chrom").cast("string")), head, path)
    return path


@query(f"""select cast(chrom as varchar) as chrom, win_id, "start", "end", sample, case sample when 'A' then 0 when 'N' then 1 else 2 end as sample_idx, total_kmers, eff_len, ob, va, id, ld, rd, ibs, {_score_sql()} as score from {_WHOLE}""")
def table_round_trip(spark, d):
    out = wintable.read_windows(spark, _written_windows(spark, d))
    return out.select("chrom", "win_id", "start", "end", "sample", "sample_idx", *[F.col(c).cast("long").alias(c) for c in ("total_kmers", "eff_len", "ob", "va", "id", "ld", "rd", "ibs")], "score")


@query("""select cast(s_suppkey as varchar) as contig, s_suppkey * 10 as length, 'orders.fa' as reference, 'A,N,R' as samples, '100' as "window" from supplier""")
def table_header(spark, d):
    head = wintable.read_header(spark, _written_windows(spark, d))
    rows = [(c, n, head.reference, ",".join(head.samples), head.params["window"]) for c, n in head.contigs.items()]
    return spark.createDataFrame(rows, "contig string, length long, reference string, samples string, window string")
