"""Interval operators over the event stream."""

from pyspark.sql import functions as F

from ..functions.time import iso_text, minute_boundaries
from ..operators import intervals as I
from ..plans import anomalies
from . import relations as B
from .registry import query

FMT = "'%Y-%m-%d %H:%M:%S'"


@query("overlap_pairs", B.with_(B.EV) + """
SELECT least(a.seq, b.seq) AS seq_1, greatest(a.seq, b.seq) AS seq_2, a.uc FROM ev a JOIN ev b
ON a.uc = b.uc AND a.seq < b.seq AND a.inicio < b.fim AND b.inicio < a.fim""")
def overlap_pairs(t):
    """JN-01/02: overlapping pairs of a UC, each once."""
    return I.overlap_pairs(B.ev(t), ["uc"], "seq", []).select(
        F.least("a_seq", "b_seq").alias("seq_1"), F.greatest("a_seq", "b_seq").alias("seq_2"), "uc")


_COVER = """FROM ev a JOIN ev b ON a.uc = b.uc AND a.seq <> b.seq AND b.inicio <= a.inicio AND b.fim >= a.fim
  AND (b.inicio < a.inicio OR b.fim > a.fim OR b.seq < a.seq)"""


@query("contained", B.with_(B.EV) + f"""
SELECT seq, uc, seq IN (SELECT a.seq {_COVER}) AS contido FROM ev""")
def contained(t):
    """JN-05: rows another event of the UC covers."""
    return I.contained(B.ev(t), ["uc"], "seq", "seq", once=True).select("seq", "uc", "contido")


@query("best_container", B.with_(B.EV) + f"""
SELECT seq, evento_contem, inicio_contem, fim_contem FROM (
  SELECT a.seq, b.seq AS evento_contem, strftime(b.inicio, {FMT}) AS inicio_contem, strftime(b.fim, {FMT}) AS fim_contem,
         row_number() OVER (PARTITION BY a.seq ORDER BY b.inicio, b.fim DESC, b.seq) AS rn {_COVER}) WHERE rn = 1""")
def best_container(t):
    """JN-06, WIN-06: earliest, longest container of each contained row."""
    return I.best_container(B.ev(t), ["uc"], "seq", "seq", once=True).where("evento_contem IS NOT NULL").select(
        "seq", "evento_contem", iso_text("inicio_contem").alias("inicio_contem"), iso_text("fim_contem").alias("fim_contem"))


@query("trim_partial", B.with_(B.EV) + f"""
SELECT * FROM (
  SELECT b.seq, a.seq AS seq_origem, strftime(a.fim, {FMT}) AS inicio_sugerido, date_diff('minute', b.inicio, a.fim) AS minutos,
         row_number() OVER (PARTITION BY b.seq ORDER BY a.fim DESC, a.inicio, a.seq) AS rn
  FROM ev b JOIN ev a ON a.uc = b.uc AND a.seq <> b.seq AND a.inicio < b.inicio AND a.fim > b.inicio AND a.fim < b.fim)
WHERE rn = 1 AND minutos > 0""".replace("SELECT * FROM (", "SELECT seq, seq_origem, inicio_sugerido, minutos FROM ("))
def trim_partial(t):
    """JN-07: partial overlap, start moved to the end of the latest-ending predecessor."""
    return I.trim_partial(B.ev(t), ["uc"], ["seq"], origin={"seq_origem": "seq"}).select(
        "seq", "seq_origem", iso_text("fim_origem").alias("inicio_sugerido"), F.col("minutos_interseccao").alias("minutos"))


def _islands_sql(key: str, extra: str = "") -> str:
    return f"""marked AS (
  SELECT *, CASE WHEN inicio <= max(fim) OVER (PARTITION BY {key} ORDER BY inicio, fim, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         THEN 0 ELSE 1 END AS novo FROM ev WHERE fim >= inicio),
numbered AS (SELECT *, sum(novo) OVER (PARTITION BY {key} ORDER BY inicio, fim, seq ROWS UNBOUNDED PRECEDING) AS p FROM marked)"""


@query("islands", B.with_(B.EV, _islands_sql("uc, protocolo")) + f"""
SELECT uc, protocolo, strftime(min(inicio), {FMT}) AS inicio, strftime(max(fim), {FMT}) AS fim, count(*) AS linhas
FROM numbered GROUP BY uc, protocolo, p""")
def islands(t):
    """WIN-09/10: merged periods per UC and protocol."""
    return I.islands(B.ev(t), ["uc", "protocolo"]).select(
        "uc", "protocolo", iso_text("inicio").alias("inicio"), iso_text("fim").alias("fim"), "linhas")


@query("islands_global", B.with_(B.EV, _islands_sql("uc")) + f"""
SELECT uc, strftime(min(inicio), {FMT}) AS inicio, strftime(max(fim), {FMT}) AS fim, bool_or(protocolo = 'error') AS expurgo, count(*) AS linhas
FROM numbered GROUP BY uc, p""")
def islands_global(t):
    """WIN-10, Q12: merged periods over all protocols, flag when any row has it."""
    rows = B.ev(t).withColumn("expurgo", F.col("protocolo") == "error")
    return I.islands(rows, ["uc"], flags=("expurgo",)).select(
        "uc", iso_text("inicio").alias("inicio"), iso_text("fim").alias("fim"), "expurgo", "linhas")


@query("islands_per_class", B.with_(B.EV, _islands_sql("uc")) + f"""
SELECT uc, protocolo = 'error' AS expurgo, strftime(min(inicio), {FMT}) AS inicio, strftime(max(fim), {FMT}) AS fim, count(*) AS linhas
FROM numbered GROUP BY uc, p, protocolo = 'error'""")
def islands_per_class(t):
    """WIN-09, Q12: periods found across classes, reported per class."""
    rows = B.ev(t).withColumn("expurgo", F.col("protocolo") == "error")
    return I.islands(rows, ["uc"], per=("expurgo",)).select(
        "uc", "expurgo", iso_text("inicio").alias("inicio"), iso_text("fim").alias("fim"), "linhas")


@query("temporal_blocks", B.with_(B.EV, _islands_sql("uc, protocolo")) + f"""
SELECT seq, min(seq) OVER w AS lider, CASE WHEN seq = min(seq) OVER w THEN 'LIDER' ELSE 'DUPLICADA' END AS status_bloco,
       strftime(min(inicio) OVER w, {FMT}) AS inicio_bloco, strftime(max(fim) OVER w, {FMT}) AS fim_bloco, count(*) OVER w AS eventos_bloco
FROM numbered WINDOW w AS (PARTITION BY uc, protocolo, p)""")
def temporal_blocks(t):
    """DOC-06: blocks of overlapping rows in one context, with leader."""
    return anomalies.context_blocks(B.ev(t), ["uc", "protocolo"], "seq").select(
        "seq", "lider", "status_bloco", iso_text("inicio_bloco").alias("inicio_bloco"), iso_text("fim_bloco").alias("fim_bloco"), "eventos_bloco")


@query("overlapped_events", B.with_(B.EV) + """
SELECT seq, EXISTS (SELECT 1 FROM ev b WHERE b.uc = a.uc AND b.seq <> a.seq AND a.inicio < b.fim AND b.inicio < a.fim) AS sobrepoe FROM ev a""")
def overlapped_events(t):
    """JN-04 at row grain: rows that overlap any other row of the UC."""
    return I.overlaps_other(B.ev(t), ["uc"]).select("seq", "sobrepoe")


@query("protocol_mixing", B.with_(B.EV) + """
SELECT seq, uc FROM ev a WHERE protocolo = 'view' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.uc = a.uc AND b.protocolo IN ('click', 'error') AND a.inicio < b.fim AND b.inicio < a.fim)""")
def protocol_mixing(t):
    """DOC-08: normal rows that overlap excluded ones on the same key."""
    code = F.when(F.col("protocolo") == "view", F.lit("0")).when(F.col("protocolo") == "click", F.lit("1")).when(F.col("protocolo") == "error", F.lit("6"))
    return anomalies.protocol_mixing(B.ev(t).withColumn("protocolo", code), ["uc"]).select("seq", "uc")


@query("short_beside_long", B.with_(B.EV) + """
SELECT seq, uc FROM ev a WHERE date_diff('minute', inicio, fim) < 3 AND EXISTS (
  SELECT 1 FROM ev b WHERE b.uc = a.uc AND b.protocolo = a.protocolo AND date_diff('minute', b.inicio, b.fim) >= 3
    AND a.inicio < b.fim AND b.inicio < a.fim)""")
def short_beside_long(t):
    """DOC-15: short rows that coincide with a long one of the same protocol."""
    rows = B.ev(t).withColumn("duracao_min", minute_boundaries("inicio", "fim"))
    return anomalies.short_beside_long(rows, ["uc", "protocolo"]).select("seq", "uc")
