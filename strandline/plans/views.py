"""Alignments, evidence and annotation derived from the driver's tables, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DNA = "substr(repeat(translate(md5(cast(l_orderkey * 10 + l_linenumber as string)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 4), 1, 100)"
N = "cast(l_quantity as int)"

#: name -> (table, columns)
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "aln": (
        "lineitem",
        {
            "read_id": "concat('r', cast(l_orderkey as string))",
            "file_ord": "cast((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey as bigint)",
            "flag": "cast(1 + (l_linenumber % 2) * 64 + (1 - l_linenumber % 2) * 128 + (l_suppkey % 2) * 16 + case when l_partkey % 37 = 0 then 256 else 0 end + case when l_partkey % 11 = 0 then 2048 else 0 end as int)",
            "chrom": "case when l_partkey % 50 = 0 then 'chrM' else concat('chr', cast(1 + l_orderkey % 3 as string)) end",
            "pos": "cast(1000 + (l_partkey * 37) % 900 as int)",
            "mapq": "cast(l_suppkey % 61 as int)",
            "cigar": f"""case l_linenumber % 8
                when 0 then '100M'
                when 1 then concat(cast({N} as string), 'S', cast(100 - {N} as string), 'M')
                when 2 then concat(cast(100 - {N} as string), 'M', cast({N} as string), 'S')
                when 3 then concat('20S', cast(80 - {N} as string), 'M', cast({N} as string), 'S')
                when 4 then concat('40M', cast({N} as string), 'D60M')
                when 5 then concat(cast({N} as string), 'S20M2I', cast(78 - {N} as string), 'M')
                when 6 then concat('50M', cast({N} * 10 as string), 'N50M')
                else case when l_partkey % 2 = 0 then '*' else concat('30M', cast({N} as string), 'D40M3I17M10H') end end""",
            "seq": DNA,
        },
    ),
    "ev": (
        "lineitem",
        {
            "read_id": "concat('r', cast(l_orderkey as string))",
            "mate": "case when l_linenumber % 2 = 1 then 'R1' else 'R2' end",
            "cigar": f"case when l_linenumber % 4 = 3 then concat('30S', cast(70 - {N} as string), 'M', cast({N} as string), 'S') else concat(cast({N} % 9 + 20 as string), 'S', cast(80 - {N} % 9 as string), 'M;', cast({N} % 9 + 20 as string), 'M', cast(80 - {N} % 9 as string), 'S') end",
            "tag": "cast(case when l_suppkey % 10 < 8 then 1 when l_suppkey % 10 = 8 then -1 else -2 end as int)",
            "chrom": "concat('chr', cast(1 + l_partkey % 3 as string))",
            "site1": "cast(1000 + (l_partkey % 160) * 50 as int)",
            "site2": "cast(1300 + (l_partkey % 160) * 50 + (l_partkey % 7) * 100 as int)",
            "strand": "case when l_partkey % 2 = 0 then '+' else '-' end",
            "signal_left": "case when l_partkey % 2 = 0 then 'AG' else 'AC' end",
            "signal_right": "case when l_partkey % 2 = 0 then 'GT' else 'CT' end",
            "q": "cast(l_linenumber % 4 as int)",
            "priority": "cast((l_partkey + l_linenumber) % 2 as int)",
        },
    ),
    "gtf": (
        "part",
        {
            "chrom": "concat('chr', cast(1 + (p_partkey % 60) % 3 as string))",
            "gene_id": "concat('g', cast(p_partkey % 60 as string))",
            "transcript_id": "concat('g', cast(p_partkey % 60 as string), '.', cast(p_partkey % 4 as string))",
            "start": "cast(900 + (p_partkey % 60) * 140 + (p_partkey * 7 % 23) * 50 as int)",
            "end": "cast(1000 + (p_partkey % 60) * 140 + (p_partkey * 7 % 23) * 50 + p_size as int)",
            "strand": "case when p_partkey % 2 = 0 then '+' else '-' end",
            "line_no": "p_partkey",
        },
    ),
    "out": (
        "lineitem",
        {
            "sample": "concat('s', cast(l_suppkey % 5 as string))",
            "junction_id": "concat('chr', cast(1 + l_partkey % 26 as string), ':', cast(1000 + l_partkey % 97 * 10 as string), '|', cast(2000 + l_partkey % 97 * 10 as string))",
            "chrom": "case l_partkey % 26 when 23 then 'chrX' when 24 then 'chrY' when 25 then 'GL000' else concat('chr', cast(1 + l_partkey % 26 as string)) end",
            "start": "cast(1000 + l_partkey % 97 * 10 as int)",
            "end": "cast(2000 + l_partkey % 97 * 10 as int)",
            "strand": "case l_partkey % 3 when 0 then '+' when 1 then '-' else '?' end",
            "reads": "cast(l_quantity as bigint)",
        },
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} as `{c}`" for c, e in columns.items()))


def cte(*names: str) -> str:
    """The views as DuckDB common table expressions."""
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        body = ", ".join(f'{e} as "{c}"' for c, e in columns.items())
        parts.append(f"{name} as (select {body} from {table})")
    return ", ".join(parts)
