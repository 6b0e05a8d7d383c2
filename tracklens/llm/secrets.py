"""Secret scans with corpus-wide ownership, in SQL functions only.

Candidates come from patterns. Their places follow from what is left of a text when it is
split at the same pattern: a match starts where the pieces and matches before it end.

Whether a candidate matters is then asked of the whole corpus: the digests of all candidates
are counted by distinct repositories and owners. A value that many owners have, or many
repositories, was copied from documentation; a random-looking one that few have looks live. Counts are reduced
to distinct (digest, repository, owner) rows before they are moved by digest, so a value that
stands in a third of all documents costs no more than its owners.

Defined results: a null text is empty; a null repository or owner is one unnamed one; repeated
rows give repeated results; extra columns are kept, and one named as a result is replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import before_each, join_counted, piece, quoted, staged, text_blocks

#: Fixed patterns, in the syntax that Java and RE2 share. ``hex`` and ``access`` state their least length, which matches
#: the same as dropping shorter maximal runs; ``assign`` is filtered afterwards, without retries.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "provider": "|".join([
        r"gh[pousr]_[A-Za-z0-9]{36,}",
        r"xox[abprs]-[A-Za-z0-9-]{10,}",
        r"[sr]k_live_[A-Za-z0-9]{16,}",
        r"AIza[A-Za-z0-9_-]{35}",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    ]),
}
KINDS = list(PATTERNS)
BASE_KINDS = KINDS[:3]
LEAST_ASSIGNED = 6
#: From this many distinct owners on, or this many repositories of whomever, a value is a copied example.
WIDE_OWNERS, WIDE_REPOS = 3, 5
#: A live-looking value has a digit, a letter, this many characters, and no such word.
LEAST_LIVE = 8
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|test|xxxx|0000|1234"
#: For redaction: a private key from its header to its END line or, where that is missing, to the last line of its body.
#: Repeated groups are possessive, which Java's engine goes through in a loop; others recurse and overflow the stack on long keys.
#: What a header is followed by is read up to the next header only, so many headers take time in proportion.
_BREAK = r"(?:\s|\\[rn])"
WHOLE_KEY = (
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY-----"
    r"(?:(?:[A-Za-z0-9+/=\s:,.\\]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY-----"
    rf"|(?:{_BREAK}++(?:(?:Proc-Type|DEK-Info): ?[A-Za-z0-9,-]{{1,200}}|[A-Za-z0-9+/=]{{16,}}))*+(?:{_BREAK}++[A-Za-z0-9+/]{{1,15}}={{1,2}})?)"
)
WHOLE_PATTERNS = PATTERNS | {"provider": PATTERNS["provider"].rpartition("|")[0] + "|" + WHOLE_KEY}
#: Placeholder words count only as whole words of assigned values.
PLACEHOLDER_WORD = r"(?i)(?<![A-Za-z0-9])(?:example|sample|changeme|placeholder|dummy|your|test|x{4,}|0000|1234)(?![A-Za-z0-9])"
MARK = "[SECRET]"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_NO_SPANS = "cast(array() as array<struct<start:int, kind_no:int, end:int, value:string>>)"


def _spans(kind: str) -> str:
    """SQL for the spans of one kind, from its matches, their values, the gaps before them and where those start."""
    keep = f"length(s.value) >= {LEAST_ASSIGNED}" if kind == "assign" else "true"
    return f"""CASE WHEN size(_m_{kind}) = 0 THEN {_NO_SPANS} ELSE filter(transform(
        arrays_zip(_m_{kind}, _v_{kind}, _g_{kind}, _r_{kind}),
        x -> named_struct('start', x._r_{kind} + length(x._g_{kind}), 'kind_no', {KINDS.index(kind)},
            'end', x._r_{kind} + length(x._g_{kind}) + length(x._m_{kind}), 'value', x._v_{kind})), s -> {keep}) END"""


def candidates(df: DataFrame, text_col: str = "text", patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """``df`` with ``secrets``: all spans by start, then kind as listed; code points, end exclusive."""
    names = [c for c in df.columns if c.lower() != "secrets"]
    wide = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(names)], F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    wide = wide.withColumns({f"_m_{k}": F.expr(f"regexp_extract_all(_text, {_literal(p)}, 0)") for k, p in patterns.items()})
    some = "CASE WHEN size(_m_{0}) = 0 THEN cast(array() as array<{2}>) ELSE {1} END"
    groups = {k: f"regexp_extract_all(_text, {_literal(patterns[k])}, 1)" if k == "assign" else f"_m_{k}" for k in KINDS}
    gaps = {k: f"slice(split(_text, {_literal(patterns[k])}, -1), 1, size(_m_{k}))" for k in KINDS}
    wide = wide.withColumns({f"_v_{k}": F.expr(some.format(k, groups[k], "string")) for k in KINDS} | {f"_g_{k}": F.expr(some.format(k, gaps[k], "string")) for k in KINDS})
    wide = wide.withColumns({f"_l_{k}": F.expr(some.format(k, f"zip_with(_g_{k}, _m_{k}, (g, m) -> length(g) + length(m))", "int")) for k in KINDS})
    wide = wide.withColumns({f"_r_{k}": F.when(F.size(f"_m_{k}") > 0, before_each(F.col(f"_l_{k}"), F.lit(0), lambda a, n: a + n)).otherwise(F.expr("cast(array() as array<int>)")) for k in KINDS})
    wide = wide.withColumns({f"_s_{k}": F.expr(_spans(k)) for k in KINDS})
    made = F.array_sort(F.concat(*[F.col(f"_s_{k}") for k in KINDS])).alias("secrets")
    return wide.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], made)


def live_looking(value: Column) -> Column:
    return (F.length(value) >= LEAST_LIVE) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def live_by_kind(kind_no: Column, value: Column) -> Column:
    """Ids, keys and long hex are told by their format alone; assigned values by length and placeholder words."""
    return (kind_no != KINDS.index("assign")) | ((F.length(value) >= LEAST_LIVE) & ~value.rlike(PLACEHOLDER_WORD))


def ownership(found: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """``(digest, n_seen, n_repos, n_owners)`` of every candidate value of the corpus."""
    each = found.select(repo.alias("repo"), owner.alias("owner"), F.explode("secrets").alias("s"))
    each = each.groupBy(F.sha2(F.col("s.value"), 256).alias("digest"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("owner", F.lit("")).alias("owner")).agg(F.count("*").alias("n"))
    by_owner = each.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_seen"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(df: DataFrame, repo: Column, owner: Column, text_col: str = "text", keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """``keep`` columns with ``secrets``, each span with ``n_owners``, ``n_repos`` and ``verdict``.

    With ``whole``, spans hold private keys to their end and verdicts are those of ``live_by_kind``;
    without, those of op9's contract. The verdict is ``copied``, ``live`` or ``weak``. The spans are written once; only rows that
    have any are moved again to learn their counts.
    """
    keep = df.columns if keep is None else keep
    kept = [c for c in keep if c.lower() != "secrets"]
    inner = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)], repo.alias("_repo"), owner.alias("_owner"), quoted(text_col).alias("_body"))
    found = candidates(inner, "_body", WHOLE_PATTERNS if whole else PATTERNS).drop("_body").withColumn("_row", F.monotonically_increasing_id())
    found = staged(found, "secrets")
    some, none = found.filter(F.size("secrets") > 0), found.filter(F.size("secrets") == 0)
    live = live_by_kind(F.col("s.kind_no"), F.col("s.value")) if whole else live_looking(F.col("s.value"))
    counts = ownership(some, F.col("_repo"), F.col("_owner"))
    each = some.select("_row", F.explode("secrets").alias("s")).withColumn("digest", F.sha2(F.col("s.value"), 256))
    told = join_counted(each, counts, "digest", "n_seen", each.count()).select(
        "_row",
        F.struct(
            "s.start", "s.kind_no", "s.end", "n_owners", "n_repos",
            F.when((F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOS), "copied").when(live, "live").otherwise("weak").alias("verdict"),
        ).alias("s"),
    )
    told = told.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    names = [F.col(f"k{i}").alias(c) for i, c in enumerate(kept)]
    empty = F.expr("cast(array() as array<struct<start:int, kind_no:int, end:int, n_owners:bigint, n_repos:bigint, verdict:string>>)")
    return some.drop("secrets").join(told, "_row").select(*names, "secrets").unionByName(none.select(*names, empty.alias("secrets")))


def digests(found: DataFrame) -> DataFrame:
    """Adds counts of base kinds and verdicts, the most owners and repositories of a value, and the joined spans."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    join = lambda a: f"array_join(transform({a}, s -> concat(element_at({names}, s.kind_no + 1), ':', s.start, ':', s.end)), ',')"
    of = lambda cond: F.expr(f"cast(size(filter(secrets, s -> {cond})) as bigint)")
    return found.withColumns(
        {f"n_{k}": of(f"s.kind_no = {i}") for i, k in enumerate(KINDS)}
        | {f"n_{v}": of(f"s.verdict = '{v}'") for v in ("live", "copied", "weak")}
        | {f"most_{x}": F.expr(f"coalesce(array_max(transform(secrets, s -> s.n_{x})), 0)") for x in ("owners", "repos")}
        | {"base_sha256": F.sha2(F.expr(join(f"filter(secrets, s -> s.kind_no < {len(BASE_KINDS)})")), 256), "spans": F.expr(join("secrets"))}
    )


def redact(df: DataFrame, text_col: str = "text", verdicts: tuple[str, ...] = ("live",), spans: str = "secrets") -> DataFrame:
    """``df`` with the spans of these verdicts replaced in its text; overlapping spans become one mark."""
    names = df.columns
    at = names.index(text_col)
    wide = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], F.filter(quoted(spans), lambda s: s["verdict"].isin(*verdicts)).alias("chosen"))
    wide = wide.withColumn("ends", F.transform("chosen", lambda s: s["end"]))
    # A mark begins where no span before it reaches; what is kept before it starts where those end.
    wide = wide.withColumns({
        "reach": before_each(F.col("ends"), F.lit(0), lambda a, e: F.greatest(a, e)),
        "blocks": F.when(F.size("chosen") > 0, text_blocks(F.col(f"c{at}"))),
    })
    kept = F.filter(F.zip_with("chosen", "reach", lambda s, r: F.struct(r.alias("start"), s["start"].alias("end"))), lambda x: x["end"] >= x["start"])
    told = F.array_join(F.transform(kept, lambda x: F.concat(piece(F.col("blocks"), x["start"], x["end"]), F.lit(MARK))), "")
    whole = F.concat(told, piece(F.col("blocks"), F.array_max("ends"), F.length(f"c{at}")))
    return wide.select(*[(F.when(F.size("chosen") > 0, whole).otherwise(F.col(f"c{i}")) if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)])
