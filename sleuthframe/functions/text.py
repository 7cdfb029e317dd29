"""Entity patterns and text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Entity patterns in their order of precedence (type, pattern, confidence).
IP_V4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
ENTITY_PATTERNS = (
    ("IP_ADDRESS", IP_V4, 0.98),
    ("IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", 0.98),
    ("URL", r"""(?i)\b(?:https?|ftp)://[^\s<>'"]+\b""", 0.95),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95),
    ("DOMAIN", r"(?i)\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+"
               r"(?:com|org|net|edu|gov|io|co|uk|de|ru|cn|info|biz|onion)\b", 0.90),
    ("FILE_PATH", r"""\b[a-zA-Z]:\\(?:[^\s\\/:*?"<>|\r\n]+\\)*[^\s\\/:*?"<>|\r\n]+\b""", 0.95),
    ("FILE_PATH", r"""\\\\[a-zA-Z0-9_.-]+\\[^\s\\/:*?"<>|\r\n]+\b""", 0.95),
    ("FILE_PATH", r"\b/(?:[a-zA-Z0-9_.-]+/)+[a-zA-Z0-9_.-]+\b", 0.90),
    ("PROCESS", r"(?i)\b[a-zA-Z0-9_.-]+\.(?:exe|dll|sys|scr|bat|cmd|ps1|vbs|py|sh|elf)\b", 0.92),
    ("HOSTNAME", r"(?i)\b(?:WIN|DESKTOP|LAPTOP|SRV|SERVER|HOST|DC)-[A-Z0-9]{4,15}\b", 0.90),
    ("TIMESTAMP", r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", 0.95),
    ("TIMESTAMP", r"\b\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}\b", 0.90),
    ("SESSION_ID", r"\bS-1-[0-5]-(?:\d+-)*\d+\b", 0.98),
    ("SESSION_ID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 0.90),
    ("COMMAND", r"(?i)\b(?:powershell(?:\.exe)?|cmd(?:\.exe)?|bash|sh|sudo|wmic|net\s+(?:user|group|localgroup)|"
                r"reg\s+(?:add|delete|query)|taskkill|vssadmin|bcedit)\s+[^\r\n]+", 0.88),
    ("USERNAME", r"(?i)\b(?:[a-zA-Z0-9._-]+@[a-zA-Z0-9.-]+|[a-zA-Z0-9._-]+\\[a-zA-Z0-9._-]+|"
                 r"(?:user|username|targetusername|subjectusername)[\s:=]+([a-zA-Z0-9._-]+))\b", 0.85),
    ("PERSON", r"\b(?:User|Author|Investigator|Subject|Owner|Admin|Analyst)[:=]\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b",
     0.88),
)
# A text without this literal cannot match the pattern of the same position ("" = no such literal).
NEEDED_LITERALS = (".", ":", "://", "@", ".", ":\\", "\\\\", "/", ".", "-", ":", ":", "S-1-", "-", "", "", "")
# Words that mark a line as an event.
EVENT_WORDS = ("login", "failed", "unauthorized", "mimikatz", "connection", "execution", "event id", "alert",
               "error", "warning")
# Fixed value: products and version numbers.
SOFTWARE = (r"(?i)\b(google\s+chrome|chrome|mozilla\s+firefox|firefox|adobe\s+reader|acrobat|"
            r"openssl|apache|tomcat|java|vlc|winrar|7-zip|7zip|putty)\b[\s_:-]*(?:version\s*)?v?(\d+(?:\.\d+){1,3})")
IOC_URL = r"""(?i)\bhttps?://[^\s<>"']+"""

# Character classes and \b follow Unicode, which is what the patterns were written for.
UNICODE = "(?U)"
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_CHUNK = 256
_REACH = 40


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(UNICODE + pattern), F.lit(group))


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


# ---- entities ---------------------------------------------------------------

def _accepted() -> Column:
    """Whether a stripped value is long enough and of the kind its type says."""
    kind, size = F.col("artifact_type"), F.length("value")
    least = F.when(kind.isin("USERNAME", "HOSTNAME"), 5).when(kind == "PERSON", 3).when(kind == "EVENT", 10).otherwise(2)
    return ((size >= least)
            & ~((kind == "DOMAIN") & (F.col("value").contains("/") | F.col("value").contains("\\")
                                      | F.col("value").rlike("^" + UNICODE + IP_V4)))
            & ~(kind.isin("HOSTNAME", "USERNAME", "PROCESS") & F.col("value").rlike(r"(?U)^\d+$")))


def entity_values(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, artifact_type, entity (lower-cased value), confidence (the greatest), n_hits: the entities without their places.

    Each text is matched once, and no offsets or snippets are made; equal entities
    of a text are counted before they are shuffled.
    """
    body = F.col(text)

    def values(kind: str, pattern: str) -> Column:
        whole = find_all(body, pattern)
        if kind not in ("USERNAME", "PERSON"):
            return whole
        return F.zip_with(find_all(body, pattern, 1), whole, lambda g, m: F.when(g != "", g).otherwise(m))

    def found(kind: str, confidence: float, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"), F.lit(confidence).alias("confidence"), values.alias("values"))

    every = [found(kind, confidence, F.when(F.contains(body, F.lit(needed)), values(kind, pattern)) if needed else values(kind, pattern))
             for (kind, pattern, confidence), needed in zip(ENTITY_PATTERNS, NEEDED_LITERALS)]
    every.append(found("EVENT", 0.85, F.filter(lines(body), lambda line: F.lower(line).rlike("|".join(EVENT_WORDS)))))
    hits = docs.filter(F.length(text) > 0).select(*keys, F.inline(F.array(*every)))
    hits = hits.select(*keys, "artifact_type", "confidence", F.explode(F.transform("values", strip)).alias("value")).filter(_accepted())
    return (hits.groupBy(*keys, "artifact_type", F.lower("value").alias("entity"))
            .agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_hits")))


def entity_hits(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Every accepted pattern hit with its offsets and snippet, one row per hit.

    The patterns are one literal array walked per text, so the plan stays small.
    Where a pattern hits, the text is cut at the hits into gap, hit, gap, ..., gap
    (``pieces``); offsets are chunked sums of piece lengths and the context is read
    from neighbouring pieces, so work grows with the text, not with text times hits.
    """
    grouped = ("USERNAME", "PERSON")
    specs = F.array(*[F.struct(F.lit(n).alias("spec"), F.lit(kind).alias("artifact_type"),
                               F.lit(UNICODE + pattern).alias("pattern"), F.lit(NEEDED_LITERALS[n]).alias("needed"),
                               F.lit(confidence).alias("confidence"),
                               F.lit(kind in grouped).alias("grouped"),
                               F.lit("person_prefix" if kind == "PERSON" else pattern.removeprefix("(?i)")[:30]).alias("rule"))
                      for n, (kind, pattern, confidence) in enumerate(ENTITY_PATTERNS)])
    body = F.col(text)
    fields = ("spec", "artifact_type", "pattern", "confidence", "grouped", "rule")
    possible = F.filter(specs, lambda s: F.contains(body, s["needed"]))
    matched = F.filter(
        F.transform(possible, lambda s: F.struct(*[s[f].alias(f) for f in fields],
                                              F.regexp_extract_all(body, s["pattern"], F.lit(0)).alias("m"))),
        lambda s: F.size(s["m"]) > 0)
    none = F.array().cast("array<string>")
    cut = F.transform(matched, lambda s: F.struct(
        *[s[f].alias(f) for f in fields if f != "pattern"], s["m"].alias("m"),
        F.when(s["grouped"], F.regexp_extract_all(body, s["pattern"], F.lit(1))).otherwise(none).alias("g"),
        F.flatten(F.transform(F.arrays_zip(F.split(body, s["pattern"], -1).alias("gap"), s["m"].alias("hit")),
                              lambda z: F.array(F.coalesce(z["gap"], F.lit("")), F.coalesce(z["hit"], F.lit(""))))).alias("p")))
    per_spec = (docs.filter(F.length(text) > 0)
                .select(*keys, F.length(text).alias("n_chars"), F.explode(cut).alias("s"))
                .select(*keys, "n_chars", "s.*"))
    # chunk_ends[c] is the offset at which chunk c of the hits begins
    per_spec = per_spec.withColumn("sizes", F.expr(
        "transform(sequence(0, size(m) - 1), i -> length(p[2 * i]) + length(p[2 * i + 1]))"))
    per_spec = per_spec.withColumn("chunk_sums", F.expr(
        f"transform(sequence(0, cast((size(sizes) - 1) div {_CHUNK} as int)), "
        f"c -> aggregate(slice(sizes, c * {_CHUNK} + 1, {_CHUNK}), 0, (a, x) -> a + x))"))
    per_spec = per_spec.withColumn("chunk_starts", F.expr(
        "transform(sequence(0, size(chunk_sums) - 1), "
        "c -> if(c = 0, 0, aggregate(slice(chunk_sums, 1, c), 0, (a, x) -> a + x)))"))
    hit = F.expr(f"""transform(sequence(0, size(m) - 1), i -> named_struct(
        'value', if(size(g) > 0 and g[i] <> '', g[i], m[i]),
        'matched', m[i],
        'end_char', chunk_starts[cast(i div {_CHUNK} as int)] + aggregate(
            slice(sizes, cast(i div {_CHUNK} as int) * {_CHUNK} + 1, i % {_CHUNK} + 1), 0, (a, x) -> a + x),
        'before', array_join(slice(p, greatest(1, 2 * i - {2 * _REACH - 2}), least(2 * i + 1, {2 * _REACH})), ''),
        'after', array_join(slice(p, 2 * i + 3, {2 * _REACH}), '')))""")
    hits = per_spec.select(*keys, "n_chars", "spec", "artifact_type", "confidence", "rule",
                           F.explode(hit).alias("h")).select(
        *keys, "n_chars", "spec", "artifact_type", "confidence", "rule", "h.*")
    # a captured group is the tail of its match: what precedes it there belongs to the left context
    hits = hits.withColumns({
        "length": F.length("value"), "start_char": F.col("end_char") - F.length("value"), "value": strip(F.col("value")),
        "lead": F.concat("before", F.expr("left(matched, length(matched) - length(value))"))})
    hits, kind = hits.filter(_accepted()), F.col("artifact_type")
    window = F.concat(F.expr(f"right(lead, {_REACH})"), F.expr("right(matched, length)"), F.expr(f"left(after, {_REACH})"))
    plain = F.translate(window, "\r\n", "  ")
    clipped = (F.col("start_char") > _REACH) | (F.col("end_char") + _REACH < F.col("n_chars"))
    return hits.select(
        *keys, "spec", "artifact_type", "value", "confidence",
        F.when(kind == "PERSON", "rule-based").otherwise("regex-fallback").alias("extractor"),
        F.when(clipped, F.concat(F.lit("..."), plain, F.lit("..."))).otherwise(plain).alias("context_snippet"),
        F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"), "rule")


def event_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines that speak of an event, with their line number."""
    line = docs.select(*keys, F.posexplode(lines(F.col(text))).alias("pos", "line"))
    line = line.select(*keys, (F.col("pos") + 1).cast("long").alias("line_number"), strip(F.col("line")).alias("line"))
    words = F.lower("line").rlike("|".join(EVENT_WORDS))
    return line.filter(words & (F.length("line") >= 10)).select(
        *keys, "line_number", F.col("line").alias("value"),
        F.substring("line", 1, 150).alias("context_snippet"))


def extract_entities(docs: DataFrame, keys: list[str], text: str = "text", scorer=None) -> DataFrame:
    """All entities of the texts, one row per (text, type, lower-cased value).

    The most confident hit wins; on equal confidence the first in pattern order,
    then in the text.  ``scorer`` may be a function from the texts to further hits
    in the shape of ``entity_hits`` (a named-entity model, say); they come first.
    """
    hits = entity_hits(docs, keys, text)
    events = event_lines(docs, keys, text).select(
        *keys, F.lit(len(ENTITY_PATTERNS)).alias("spec"), F.lit("EVENT").alias("artifact_type"), "value",
        F.lit(0.85).alias("confidence"), F.lit("rule-based").alias("extractor"), "context_snippet",
        F.lit(None).cast("long").alias("start_char"), F.lit(None).cast("long").alias("end_char"),
        F.concat(F.lit("line "), F.col("line_number").cast("string")).alias("rule"),
        F.col("line_number").alias("_pos"))
    every = hits.withColumn("_pos", F.col("start_char")).unionByName(events)
    if scorer is not None:
        every = scorer(docs).withColumns({"spec": F.lit(-1), "_pos": F.col("start_char")}).unionByName(every)
    return best_entities(every, keys)


def best_entities(hits: DataFrame, keys: list[str]) -> DataFrame:
    kept = ("value", "confidence", "extractor", "context_snippet", "start_char", "end_char", "rule")
    first = F.min(F.struct((-F.col("confidence")).alias("_c"), "spec", "_pos", *kept)).alias("_b")
    return (hits.groupBy(*keys, "artifact_type", F.lower("value").alias("_v")).agg(first)
            .select(*keys, "artifact_type", *[F.col(f"_b.{c}").alias(c) for c in kept]))


# ---- text assembly, software, indicators ----------------------------------

def assembled_text(filename: Column, extension: Column, mime: Column, metadata: Column, body: Column) -> Column:
    """Header line, metadata JSON and the whole body, joined by newlines."""
    header = F.concat(F.lit("Filename: "), filename, F.lit(" Extension: "), extension, F.lit(" MIME: "), mime)
    return F.concat_ws("\n", header, metadata, body)


def searchable_text(filename: Column, mime: Column, extension: Column, *metadata: Column) -> Column:
    return F.concat_ws(" ", F.translate(filename, "_-", "  "), mime, extension,
                       *[F.when(m != "", m) for m in metadata])


def software(text: Column) -> Column:
    """Distinct (product, version) of a text."""
    product = F.transform(find_all(text, SOFTWARE, 1),
                          lambda p: F.regexp_replace(F.lower(p), r"(?U)\s+", " "))
    version = find_all(text, SOFTWARE, 2)
    return F.array_distinct(F.arrays_zip(product.alias("product"), version.alias("version")))


def indicators(text: Column, sha256: Column) -> Column:
    """Addresses, links and the file digest of a text as (indicator_type, value)."""
    def typed(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("indicator_type"), v.alias("value")))
    links = F.transform(F.array_sort(F.array_distinct(find_all(text, IOC_URL))),
                        lambda u: F.regexp_replace(u, r"[.,;)]+$", ""))
    return F.concat(typed("ip", F.array_sort(F.array_distinct(find_all(text, IP_V4)))),
                    typed("url", links), typed("sha256", F.array(sha256)))


def hash_tokens(text: Column) -> Column:
    """Distinct hexadecimal words of 32, 40 or 64 digits with the digest they look like."""
    words = F.filter(F.array_distinct(F.transform(find_all(text, r"\b[a-fA-F0-9]+\b"), F.lower)),
                     lambda w: F.length(w).isin(32, 40, 64))
    return F.transform(words, lambda w: F.struct(
        w.alias("hash"),
        F.when(F.length(w) == 32, "MD5").when(F.length(w) == 40, "SHA-1").otherwise("SHA-256").alias("type"),
        F.length(w).cast("long").alias("length")))


# ---- names and links --------------------------------------------------------

def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffixes(name: Column) -> Column:
    """File suffixes with their dots; a leading dot does not start one, a trailing dot ends them."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    tail = F.regexp_replace(base, r"^\.+", "")
    return F.when(base.endswith("."), F.array().cast("array<string>")).otherwise(
        F.transform(F.regexp_extract_all(tail, F.lit(r"(\.[^.]*)"), F.lit(1)), lambda s: s))


def is_uuid(value: Column) -> Column:
    """32 hexadecimal digits, however dashed, after an optional ``urn:`` and ``uuid:`` and inside optional braces."""
    bare = F.regexp_replace(F.regexp_replace(value, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", "")
    return F.translate(bare, "-", "").rlike(r"\A(?i)[0-9a-f]{32}\z")


def gps_decimal(parts: Column, reference: Column) -> Column:
    """Degrees, minutes, seconds to a signed decimal degree."""
    value = F.get(parts, F.lit(0)) + F.get(parts, F.lit(1)) / 60.0 + F.get(parts, F.lit(2)) / 3600.0
    return F.when(F.size(parts) == 3, F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value))
