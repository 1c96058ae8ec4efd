"""Secret scan with a randomness test battery (operator 7, native)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running_join

# Fixed values of the contract: the base patterns. A length is part of a pattern only where that
# gives the same matches as dropping shorter ones afterwards (one greedy run of one class).
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")     # ties of a start are listed in this order

# Candidates of the battery: long runs, and what lies in them between separators ("=" ends a
# candidate as padding), so that a path or a name before a secret is not tested with it.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
PARTS = (r"[A-Za-z0-9+/_-]{20,}=*", r"[A-Za-z0-9+_-]{20,}=*", r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9+]{20,}=*")
# Encoding, pattern of the whole token, its symbols in order, concentration (sum of squared
# shares) that ordinary text has over these symbols.
_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", "[0-9a-f]+", _DIGITS + "abcdef", 0.14),
    ("hex upper", "[0-9A-F]+", _DIGITS + "ABCDEF", 0.14),
    ("base32", "[A-Z2-7]+=*", _UP + "234567", 0.065),
    ("base36", "[a-z0-9]+", _DIGITS + _LOW, 0.065),
    ("base36 upper", "[A-Z0-9]+", _DIGITS + _UP, 0.065),
    ("base62", "[A-Za-z0-9]+", _DIGITS + _UP + _LOW, 0.065),
    ("base64", "[A-Za-z0-9+/]+=*", _DIGITS + _UP + _LOW + "+/", 0.065),
    ("base64 url", "[A-Za-z0-9_-]+=*", _DIGITS + _UP + _LOW + "-_", 0.065),
    ("mixed", ".*", _DIGITS + _UP + _LOW + "+/-_=", 0.065),
)
REJECT = 0.003          # a token whose smallest test value (times three) is below is not random
FALSE_SHARE = 0.01      # expected share of ordinary tokens among those reported
BINS, BIN = 120, 0.25   # p-values are counted in quarter decades
PIECE = 4096            # code points from which parts of a text are taken


def normal(z: Column) -> Column:
    """Normal distribution function by a logistic curve; monotone, off by 2e-4 at most."""
    return let(z, lambda z: 1 / (1 + F.exp(-F.greatest(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(60.0)), F.lit(-600.0)))))


def stops(pieces: Column, matches: Column) -> Column:
    """End of each match: running lengths of the matches and of the text between them."""
    size = lambda x: F.length(x).cast("long")
    return running_join(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: size(p) + size(m)),
                        lambda a, b: a + b)


def located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans ``(start, kind, stop)`` in code points of the leftmost non-overlapping matches.

    The text between the matches is taken by the same pattern, so lengths
    give the places. ``keep`` looks at a match and drops it after matching.
    """
    def spans(m: Column) -> Column:
        placed = F.zip_with(m, stops(F.split(text, pattern, -1), m), lambda x, z: F.struct(
            (z - F.length(x)).alias("start"), F.lit(kind).alias("kind"), z.alias("stop"), x.alias("found")))
        return placed if keep is None else F.filter(placed, lambda x: keep(x["found"]))

    none = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,found:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m)))


def base_spans(text: Column) -> Column:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_VALUE
    return F.sort_array(F.concat(located(text, ASSIGN, 0, value), located(text, ACCESS, 1), located(text, HEX, 2)))


def battery(token: Column) -> Column:
    """``(p, sound)`` of a token under the encoding inferred from its symbols.

    ``sound``: uniformity (chi-squared over the alphabet), runs above and
    below its middle, and lag-one serial correlation all agree with random
    symbols. ``p``: how likely ordinary text of this length looks at least
    as uniform, by the noncentral chi-squared its concentration implies; it
    falls with length, so short tokens are never sure.
    """
    def figures(core: Column, e: Column) -> Column:
        """Sums over the symbols; what counts signs only is left to functions on text."""
        def of(letters: Column) -> Column:
            x = F.transform(letters, lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))
            counts = F.transform(F.array_distinct(letters), lambda c: F.length(core) - F.length(F.replace(core, c, F.lit(""))))
            return let(x, lambda x: F.struct(
                F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c * c).cast("double").alias("squares"),
                F.aggregate(x, F.lit(0.0), lambda a, v: a + v).alias("sum"),
                F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("sum2"),
                F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda v, w: v * w),
                            F.lit(0.0), lambda a, v: a + v).alias("lag"),
                (F.get(x, F.lit(0)) + F.get(x, F.size(x) - 1)).alias("ends")))

        sides = F.call_function("translate", core, e["alphabet"], e["sides"])
        seen = lambda t, what: ((F.length(t) - F.length(F.replace(t, F.lit(what), F.lit("")))) / len(what))
        runs = let(sides, lambda t: F.struct(seen(t, "H").alias("high"), (1 + seen(t, "LH") + seen(t, "HL")).alias("runs")))
        return F.struct(F.length(core).cast("double").alias("n"), F.length(e["alphabet"]).cast("double").alias("size"),
                        let(F.filter(F.split(core, ""), lambda c: c != ""), of).alias("x"), runs.alias("r"))

    def verdict(f: Column, concentration: Column) -> Column:
        n, size, x = f["n"], f["size"], f["x"]
        chi, df, shift = x["squares"] * size / n - n, size - 1, n * (size * concentration - 1)
        text_like = normal((chi - df - shift) / F.sqrt(2 * (df + 2 * shift)))
        wilson = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        expect = 1 + 2 * f["r"]["high"] * (n - f["r"]["high"]) / n
        spread = F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9))
        mean = x["sum"] / n
        own = x["sum2"] - x["sum"] * mean
        lag = x["lag"] - mean * (2 * x["sum"] - x["ends"]) + (n - 1) * mean * mean
        two_sided = lambda z: 2 * normal(-F.abs(z))
        worst = F.least(1 - normal(wilson), two_sided((f["r"]["runs"] - expect) / F.sqrt(spread)),
                        two_sided(F.when(own > 1e-9, lag / own).otherwise(F.lit(1.0)) * F.sqrt(n)))
        return F.struct(text_like.alias("p"), (3 * worst >= REJECT).alias("sound"))

    inferred = None
    for _, pattern, alphabet, concentration in reversed(ENCODINGS):
        half = len(alphabet) // 2
        here = F.struct(F.lit(alphabet).alias("alphabet"), F.lit("L" * half + "H" * (len(alphabet) - half)).alias("sides"),
                        F.lit(concentration).alias("concentration"))
        inferred = here if inferred is None else F.when(token.rlike(f"^(?:{pattern})$"), here).otherwise(inferred)
    found = F.struct(F.regexp_replace(token, "=+$|[^A-Za-z0-9+/_=-]", "").alias("core"), inferred.alias("e"))
    return let(found, lambda t: let(figures(t["core"], t["e"]), lambda f: verdict(f, t["e"]["concentration"])))


def stratum(token: Column) -> Column:
    """Length class of a token: powers of two."""
    return F.floor(F.log2(F.length(token))).cast("int")


def p_bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(p) / BIN), F.lit(BINS)).cast("int")


def once(spans: Column) -> Column:
    """Each span once, in order."""
    return let(F.sort_array(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def outermost(spans: Column) -> Column:
    """Spans that lie in no other: by start, the longer first, none before them ends as late."""
    def of(a: Column) -> Column:
        return let(running_join(F.transform(a, lambda x: x["span"]["stop"]), F.greatest), lambda reach: F.transform(
            F.filter(a, lambda x, i: (i == 0) | (F.get(reach, i - 1) < x["span"]["stop"])), lambda x: x["span"]))

    return let(F.sort_array(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["stop"]).alias("back"), x.alias("span")))), of)


def clear_of(spans: Column, base: Column) -> Column:
    """Spans that touch none of ``base``: of the base that starts before a span's end, none ends behind its start."""
    def of(spans: Column) -> Column:
        def kept(events: Column) -> Column:
            reach = running_join(F.transform(events, lambda e: e["reach"]), F.greatest)
            return let(reach, lambda r: F.transform(
                F.filter(events, lambda e, i: (e["base"] == 0) & (F.get(r, i) <= F.get(spans, e["at"])["start"])),
                lambda e: F.get(spans, e["at"])))

        event = lambda place, is_base, reach, at: F.struct(
            place.alias("place"), F.lit(is_base).alias("base"), reach.alias("reach"), at.alias("at"))
        nothing = F.lit(-1).cast("long")
        ends = F.transform(spans, lambda x, i: event(x["stop"], 0, nothing, i))
        begins = F.transform(base, lambda y: event(y["start"], 1, y["stop"], F.lit(-1)))
        return let(F.sort_array(F.concat(ends, begins)), kept)

    return F.when(F.size(base) == 0, spans).otherwise(let(spans, of))


def with_candidates(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_tf_tokens``: runs and, once each, their parts between separators; what is padding only is none.

    A part lies in a run, so its pattern finds it in the text as well. Built
    column by column: one deep expression takes the analyser too long.
    """
    runs = F.filter(located(text, TOKEN, 3), lambda x: x["found"].rlike("[^=].*[^=]"))
    split = F.exists("_tf_runs", lambda x: x["found"].rlike("[/=_-]"))
    parts = F.when(split, F.concat(*[located(text, p, 3) for p in PARTS])).otherwise(F.slice("_tf_runs", 1, 0))
    return (df.withColumn("_tf_runs", runs).withColumn("_tf_parts", parts)
            .withColumn("_tf_tokens", once(F.concat("_tf_runs", "_tf_parts"))).drop("_tf_runs", "_tf_parts"))


def thresholds(docs: DataFrame, text_col: str) -> dict[int, int]:
    """Lowest p-value bin that is reported, per length class.

    Benjamini-Hochberg steps inside each length class over all candidate
    tokens of the corpus, on binned p-values (a bin counts as its largest).
    Only counts leave the executors: at most 31 length classes times the bins.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    counts = (with_candidates(texts, F.col("_text")).select(F.explode("_tf_tokens.found").alias("_t"))
              .select(stratum(F.col("_t")).alias("_s"), battery(F.col("_t")).alias("_b"))
              .select("_s", p_bin(F.col("_b.p")).alias("_p")).groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("n")).collect())
    out = {}
    for s in {r["_s"] for r in counts}:
        bins = {r["_p"]: r["n"] for r in counts if r["_s"] == s}
        total = sum(bins.values())
        fine = [b for b in sorted(bins)
                if total * 10 ** (-b * BIN) <= FALSE_SHARE * sum(n for k, n in bins.items() if k >= b)]
        if fine:
            out[s] = fine[0]
    return out


def listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(name, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "secret_spans") -> DataFrame:
    """``docs`` with their spans: ``start``, ``kind`` (place in ``KINDS``), ``stop``, ``found``.

    Base spans and, beside them, the outermost random tokens that the
    battery reports. Two passes over the texts: one for the length-wise
    thresholds, one for the spans; no text is shuffled. Null and empty texts
    have no spans.
    """
    limits = thresholds(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if not limits:
        return docs.withColumn(name, base_spans(text))

    def reported(x: Column) -> Column:
        least = reduce(lambda other, s: F.when(stratum(x["found"]) == s, F.lit(limits[s])).otherwise(other),
                       sorted(limits), F.lit(BINS + 1))
        return let(battery(x["found"]), lambda b: b["sound"] & (p_bin(b["p"]) >= least))

    return (with_candidates(docs.withColumn("_tf_base", base_spans(text)), text)
            .withColumn("_tf_tokens", clear_of(F.col("_tf_tokens"), F.col("_tf_base")))
            .withColumn("_tf_tokens", outermost(F.filter("_tf_tokens", reported)))
            .withColumn(name, F.sort_array(F.concat("_tf_base", "_tf_tokens"))).drop("_tf_base", "_tf_tokens"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every document.

    Returns id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``,
    ``spans`` (``kind:start:end`` by start, then kind; code points, end
    exclusive). Repeated rows are scanned each; null and empty texts have
    none; an empty table gives no rows; other columns are ignored.
    """
    found = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", "_s")
    count = lambda k: F.size(F.filter("_s", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("_s", lambda s: s["kind"] < KINDS.index("random"))
    return found.select(F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"),
                        count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("_s")).alias("spans"))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with sorted ``spans`` replaced, overlapping ones as one; in time close to its length.

    Finding a place in a text takes as long as the place is far, so the
    parts to keep are taken from pieces of ``PIECE`` code points.
    """
    def of(pieces: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            p, q = (F.floor(x / PIECE).cast("int") for x in (a, b))
            i, j = ((x % PIECE).cast("int") for x in (a, b))
            across = F.concat(F.substr(F.get(pieces, p), i + 1), F.array_join(F.slice(pieces, p + 2, q - p - 1), ""),
                              F.coalesce(F.substr(F.get(pieces, q), F.lit(1), j), F.lit("")))
            return F.when(a >= b, F.lit("")).when(p == q, F.substr(F.get(pieces, p), i + 1, j - i)).otherwise(across)

        def joined(reach: Column) -> Column:
            before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(
                part(before(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), part(before(F.size(reach)), F.length(text).cast("long")))

        return let(running_join(F.transform(spans, lambda s: s["stop"]), F.greatest), joined)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
             chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one.

    Columns are kept; ``chars_col``, if there, is renewed where the text
    changed. Every row stays, repeated ones too; null and empty texts and
    texts without a span stay as they are; an empty table gives no rows.
    Spans and texts of any number and length are swept in sorted order.
    """
    text = F.col(text_col)
    hit = F.size("_tf_spans") > 0
    out = with_spans(docs, text_col, "_tf_spans").withColumn("_tf_clean", F.when(hit, masked(text, F.col("_tf_spans"), mark)))
    new = {text_col: F.when(hit, F.col("_tf_clean")).otherwise(text)}
    if chars_col in docs.columns:
        new[chars_col] = F.when(hit, F.length("_tf_clean").cast(docs.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return out.withColumns(new).select(*docs.columns)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
