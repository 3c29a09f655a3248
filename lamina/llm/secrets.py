"""Secret scan with multipart credential linking, in DataFrame expressions only.

Base kinds are always reported: assignments to a secret's name, access identifiers and long hex runs. Weak candidates
(user or client names, bare key-like strings, endpoints) are reported only where a complementary part lies within the
same scope: an interval join of the candidates inside each document, on the distance between spans.

Key-like strings are runs of 32 and more letters, digits and signs of base64 or base64url with a digit and a capital,
also behind an equals sign, with up to two equals signs at their end. Names of users and clients have 3 characters and
more, endpoints any number.

Defined results: a null text counts as empty; texts without findings have an empty list; spans are code points with the
end excluded; spans that start together are in the order of kinds, then of ends;
repeated rows are scanned each on its own. A very long text is one row of its task; time is near to linear in its matches.
findings reads the id and text columns alone; redact passes on all others, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import column, fresh, let

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of 24 and more, the same as all runs without the short ones
#: The start of a word, by the letters and digits of ASCII alone; what Java takes for one depends on its version.
BOUNDARY = "(?<![A-Za-z0-9_])"
WEAK_ID = rf"""{BOUNDARY}(?i:user(?:_?name)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{{3,}}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = rf"""{BOUNDARY}(?i:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\x20\x09-\x0D"'<>]+"""
#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Parts belong together when the gap between their spans has at most this many code points.
SCOPE = 200

#: Elements that are folded into one array before the arrays are put together.
FOLD = 256

SPAN = "struct<start:int,rank:int,end:int>"


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def fold(n: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """What emit(state, i) gives for i from 0 to n - 1, where step(state, i) makes the state of the next i. Arrays grow
    by copies, so they are made in blocks: the time is near to linear in n."""

    def one(acc: Column, i: Column) -> Column:
        return F.struct(step(acc["state"], i).alias("state"), F.array_append(acc["out"], emit(acc["state"], i)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        inside = F.aggregate(F.sequence(b * FOLD, F.least(n, b * FOLD + FOLD) - 1), F.struct(acc["state"].alias("state"), none(kind).alias("out")), one)
        return let(inside, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["out"], r["out"]).alias("out")))

    blocks = F.aggregate(F.sequence(F.lit(0), ((n - 1) / FOLD).cast("int")), F.struct(state.alias("state"), none(f"array<{kind}>").alias("out")), block, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, blocks).otherwise(none(kind))


def find(d: DataFrame, text: Column, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds for each name the spans of all matches of its pattern, with its rank. The pieces between matches and the
    matches themselves add up to positions."""
    pieces, hits = ({k: n for k, n in zip(patterns, fresh(d, *[f"{x}_{k}" for k in patterns]), strict=True)} for x in ("pieces", "hits"))
    parts = {pieces[k]: F.when(text.rlike(p), F.split(text, p, -1)) for k, (p, _) in patterns.items()}
    parts |= {hits[k]: F.when(text.rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0))) for k, (p, _) in patterns.items()}

    def spans(pieces: Column, hits: Column, rank: int) -> Column:
        start = lambda at, i: at + F.length(F.get(pieces, i))
        end = lambda at, i: start(at, i) + F.length(F.get(hits, i))
        span = lambda at, i: F.struct(start(at, i).alias("start"), F.lit(rank).alias("rank"), end(at, i).alias("end"))
        return fold(F.size(hits), F.lit(0), end, span, SPAN)

    d = d.withColumns(parts)
    found = {k: spans(F.col(pieces[k]), F.col(hits[k]), rank) for k, (_, rank) in patterns.items()}
    longer = lambda k, p: lambda _, i: F.length(F.regexp_extract(F.get(F.col(hits[k]), i), p, 1)) >= 6
    found = {k: F.filter(s, longer(k, ASSIGN)) if patterns[k][0] == ASSIGN else s for k, s in found.items()}
    return d.withColumns(found).drop(*pieces.values(), *hits.values())


def beside(d: DataFrame, wanted: dict[str, tuple[Column, Column, int, bool]]) -> DataFrame:
    """Adds for each name, of (xs, ys, gap, whether) the spans of xs that have (or have not) a span of ys at most gap
    code points away; a gap of -1 means an overlap. A merge of both, sorted by start: forwards the furthest end of ys so
    far tells it, backwards their least start."""
    entry = "struct<start:int,rank:int,end:int,other:int>"
    both, behind, ahead = ({k: n for k, n in zip(wanted, fresh(d, *[f"{x}_{k}" for k in wanted]), strict=True)} for x in ("both", "behind", "ahead"))
    tagged = lambda zs, other: F.transform(zs, lambda z: F.struct(z["start"].alias("start"), z["rank"].alias("rank"), z["end"].alias("end"), F.lit(other).alias("other")))
    d = d.withColumns({both[k]: F.when((F.size(xs) > 0) & (F.size(ys) > 0), F.sort_array(F.concat(tagged(xs, 0), tagged(ys, 1)).cast(f"array<{entry}>"))) for k, (xs, ys, _, _) in wanted.items()})

    def forwards(all: Column, gap: int) -> Column:
        at = lambda i: F.get(all, i)
        return fold(F.size(all), F.lit(-(1 << 30)), lambda s, i: F.when(at(i)["other"] == 1, F.greatest(s, at(i)["end"])).otherwise(s), lambda s, i: at(i)["start"] - s <= gap, "boolean")

    def backwards(all: Column, gap: int) -> Column:
        at = lambda i: F.get(all, F.size(all) - 1 - i)
        return fold(F.size(all), F.lit(1 << 30), lambda s, i: F.when(at(i)["other"] == 1, F.least(s, at(i)["start"])).otherwise(s), lambda s, i: s - at(i)["end"] <= gap, "boolean")

    d = d.withColumns({behind[k]: forwards(F.col(both[k]), w[2]) for k, w in wanted.items()} | {ahead[k]: backwards(F.col(both[k]), w[2]) for k, w in wanted.items()})

    def kept(k: str, xs: Column, has: bool) -> Column:
        def of(all: Column, before: Column, after: Column) -> Column:
            near = lambda i: F.get(before, i) | F.get(after, F.size(all) - 1 - i)
            here = F.filter(all, lambda z, i: (z["other"] == 0) & (near(i) if has else ~near(i)))
            return F.transform(here, lambda z: F.struct(z["start"].alias("start"), z["rank"].alias("rank"), z["end"].alias("end")))

        # Bound before the lambdas: the optimizer may put a column's expression where it is used.
        spans = let(F.col(both[k]), lambda all: let(F.col(behind[k]), lambda before: let(F.col(ahead[k]), lambda after: of(all, before, after))))
        return F.when(F.col(both[k]).isNotNull(), spans).otherwise(none(SPAN) if has else xs)

    out = d.withColumns({k: kept(k, xs, has) for k, (xs, _, _, has) in wanted.items()})
    return out.drop(*both.values(), *behind.values(), *ahead.values())


def scan(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with the base spans and all spans, each by start, kind and end; and the names of these columns."""
    names = fresh(docs, "t", "assign", "access", "hex", "weak_id", "weak_secret", "endpoint", "base", "ids", "keys", "linked_keys", "near_ids", "near_keys", "near_ends", "spans")
    t, assign, access, hexes, weak_id, weak_secret, endpoint, base, ids, keys, linked_keys, near_ids, near_keys, near_ends, spans = names
    c = F.col
    d = docs.withColumn(t, F.coalesce(column(text_col), F.lit("")))
    d = find(d, c(t), {assign: (ASSIGN, 0), access: (ACCESS, 1), hexes: (HEX, 2), weak_id: (WEAK_ID, 3), weak_secret: (WEAK_SECRET, 4), endpoint: (ENDPOINT, 5)})
    d = d.withColumn(base, F.sort_array(F.concat(c(assign), F.filter(c(access), lambda s: s["end"] - s["start"] >= 20), c(hexes))))
    d = beside(d, {ids: (c(weak_id), c(base), -1, False), keys: (c(weak_secret), c(base), -1, False)})
    strong, identifiers = F.filter(c(base), lambda b: b["rank"] != 1), F.filter(c(base), lambda b: b["rank"] == 1)
    d = beside(d, {near_ids: (c(ids), F.concat(strong, c(keys)), SCOPE, True), near_keys: (c(keys), F.concat(identifiers, c(ids)), SCOPE, True), linked_keys: (c(keys), c(ids), SCOPE, True)})
    d = beside(d, {near_ends: (c(endpoint), F.concat(c(base), c(linked_keys)), SCOPE, True)})
    d = d.withColumn(spans, F.sort_array(F.concat(c(base), c(near_ids), c(near_keys), c(near_ends))))
    return d.drop(*(n for n in names if n not in (base, spans))), base, spans


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its base spans, all spans (arrays of start, rank of the kind, end) and the number linked."""
    d, base, spans = scan(docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text")), "text")
    return d.select("doc_id", F.col(base).alias("base"), F.col(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_linked"))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by mark; overlapping spans are replaced together. Finding a place in a text takes
    time by its distance from the start, so the parts of each FOLD spans are cut from a part of the text."""

    def of(spans: Column, ends: Column) -> Column:
        """ends: up to where the text is done before each span, and after the last."""
        n = F.size(spans)
        span, done = (lambda i: F.get(spans, i)), (lambda i: F.get(ends, i))

        def block(b: Column) -> Column:
            low, high = b * FOLD, F.least(n, b * FOLD + FOLD)
            piece = lambda part, i: F.when(span(i)["start"] < done(i), F.lit("")).otherwise(F.concat(F.substring(part, done(i) - done(low) + 1, span(i)["start"] - done(i)), F.lit(mark)))
            return let(F.substring(text, done(low) + 1, done(high) - done(low)), lambda part: F.array_join(F.transform(F.sequence(low, high - 1), lambda i: piece(part, i)), ""))

        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / FOLD).cast("int")), block)
        return F.concat(F.array_join(blocks, ""), F.substring(text, done(n) + 1, F.length(text)))

    ends = fold(F.size(spans) + 1, F.lit(0), lambda s, i: F.greatest(s, F.coalesce(F.get(spans, i)["end"], F.lit(0))), lambda s, i: s, "int")
    return F.when(F.size(spans) > 0, let(spans, lambda s: let(ends, lambda e: of(s, e)))).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with all reported spans replaced by a mark. Columns and row count stay as they are, but for n_chars,
    which follows the text where it changed."""
    names = docs.columns
    found, _, s = scan(docs, text_col)
    text = F.when(F.size(s) > 0, redacted(column(text_col), F.col(s))).otherwise(column(text_col))
    (new,) = fresh(found, "redacted")
    found = found.withColumn(new, text)
    values = {text_col: F.col(new)}
    if "n_chars" in names:
        values["n_chars"] = F.when(F.size(s) > 0, F.length(new).cast("long")).otherwise(F.col("n_chars"))
    return found.select(*[values[c].alias(c) if c in values else column(c) for c in names])
