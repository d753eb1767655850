"""Secret scan with corpus-wide ownership frequency (DataFrame functions only).

Base finder: three patterns, leftmost and non-overlapping for each kind.  The method then
adds what one text alone cannot show.  Long mixed tokens are candidates; the hash of each
candidate's value is counted over the corpus by distinct repositories and owners.  A value
that several owners hold, or one owner in many of its repositories (:data:`MAX_REPOS`,
:data:`MAX_SHARE`), is a copied example (documentation, test fixtures); a value that one owner
holds in few of its repositories and that looks live becomes a span of kind ``owned``.  Base
spans stay whatever their frequency; their counts are reported beside them.

Counting is three nested aggregations, (hash, owner, repository), (hash, owner), (hash),
so a value that a third of all rows hold is combined before every shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.shared import join_skewed, write_through

#: The base patterns, in the order in which kinds are listed.
#: Letters of the keywords are spelled in both cases (no Unicode case folding).
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"
          r"[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_VALUE = 12
#: A run that is long enough from its first place on is the leftmost match of the run.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Candidates of the method: long tokens; :func:`looks_live` chooses among them.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")

#: A value is copied when it lies in more than this share of its owner's repositories, so the
#: bound grows with the corpus; and in more than so many, as an owner of few shares freely.
MAX_SHARE, MAX_REPOS = 0.01, 100

#: Matches whose places are summed in one step (see :func:`_places`).
BLOCK = 64

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def looks_live(value: Column) -> Column:
    """Upper and lower case letters and at least two digits: no word, path or plain number."""
    return (value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9][^0-9]*[0-9]")
            & ~value.rlike(r"(?i)example|placeholder|changeme|xxxx"))


def _places(df: DataFrame, name: str, pattern: str, kind: int, keep) -> DataFrame:
    """Column ``name``: spans of the pattern's matches in ``_text`` that ``keep`` accepts.

    Spark's functions give matched texts but no places; the places follow from the lengths
    of the pieces between the matches.  Sums run within blocks of :data:`BLOCK` matches and
    over block totals, so a text of many matches takes no quadratic time."""
    found, gaps, steps, totals = "_found", "_gaps", "_steps", "_totals"
    some = F.size(found) > 0
    df = df.withColumn(found, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(some, F.transform(F.split("_text", pattern, -1), F.length)))
    # the step from one match's end to the next one's end
    df = df.withColumn(steps, F.when(some, F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                                                      lambda g, m: g + F.length(m))))
    df = df.withColumn(totals, F.when(some, F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / F.lit(BLOCK)).cast("int")),
        lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / F.lit(BLOCK)).cast("int")
        add = lambda a, x: a + x
        end = (F.aggregate(F.slice(totals, F.lit(1), block), F.lit(0), add)
               + F.aggregate(F.slice(steps, block * BLOCK + 1, i - block * BLOCK + 1), F.lit(0), add))
        return F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        m.alias("value"))

    spans = F.filter(F.transform(found, span), lambda s: keep(s["value"]))
    df = df.withColumn(name, F.when(some, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return df.drop(found, gaps, steps, totals)


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def find(df: DataFrame, text_col: str = "_text") -> DataFrame:
    """``df`` with ``_base`` (spans of the three kinds by start, then kind) and
    ``_candidates`` (live-looking tokens that no base span overlaps).  A null text is empty."""
    df = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    df = _places(df, "_assign", ASSIGN, 0, lambda m: F.length(_assigned(m)) >= ASSIGN_VALUE)
    df = _places(df, "_access", ACCESS, 1, lambda m: F.lit(True))
    df = _places(df, "_hex", HEX, 2, lambda m: F.lit(True))
    df = _places(df, "_tokens", TOKEN, 3, looks_live)
    df = df.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    return df.withColumn("_candidates", F.filter("_tokens", lambda t: ~F.exists(
        "_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))).drop("_assign", "_access", "_hex",
                                                                                      "_tokens")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def frequencies(held: DataFrame, repos: DataFrame, max_repos: int = MAX_REPOS, max_share: float = MAX_SHARE) -> DataFrame:
    """(hash, n_rows, n_repos, n_owners, spread) of rows (hash, owner, repo).

    ``repos``: (owner, repo) of all rows of the corpus.  ``spread``: some owner holds the value
    in more repositories than the bounds allow.  Null owners count as one owner, null
    repositories as one repository of their owner."""
    named = F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("of")
    totals = repos.select(named, "repo").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("of_repos"))
    each = (held.groupBy("hash", named, "repo").agg(F.count(F.lit(1)).alias("rows"))
            .groupBy("hash", "of").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("repos")))
    each = join_skewed(write_through(each, "secret-owners"), totals, ["of"])
    bound = F.greatest(F.lit(max_repos).cast("double"), F.col("of_repos") * max_share)
    return each.groupBy("hash").agg(F.sum("rows").alias("n_rows"), F.sum("repos").alias("n_repos"),
                                    F.count(F.lit(1)).alias("n_owners"), F.max(F.col("repos") > bound).alias("spread"))


def scan_secrets(df: DataFrame, text_col: str, owner_col: str, repo_col: str,
                 keep: dict[str, str] | None = None, max_owners: int = 1, copied_owners: int = 2,
                 max_repos: int = MAX_REPOS, max_share: float = MAX_SHARE) -> DataFrame:
    """One row for each row of ``df``: the columns of ``keep`` (new name: column), ``base``
    and ``spans`` (arrays of structs), ``n_copied`` (base spans whose value is copied: at least
    ``copied_owners`` owners hold it, or one owner in more than ``max_repos`` and more than
    ``max_share`` of its repositories) and ``n_live`` (the rest).

    The method adds a candidate when at most ``max_owners`` owners hold its value and none of
    them in more repositories than that.  Spans are sorted by start, then kind.  Null and
    empty texts have no spans; very long texts are searched whole; null owners and repositories count as
    one each; repeated rows stay rows of their own (and one holder); an empty table gives no
    rows; other columns take no part."""
    keep = keep or {}
    rows = df.select(*[F.col(c).alias(f"k_{n}") for n, c in keep.items()], F.col(text_col).alias("_raw"),
                     F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    found = find(rows, "_raw").select(*[f"k_{n}" for n in keep], "owner", "repo", "_base", "_candidates")
    # spans only, no texts; written, so the scan runs once and the running number is fixed
    found = write_through(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    value = F.when(F.col("s.kind") == 0, _assigned(F.col("s.value"))).otherwise(F.col("s.value"))
    held = (found.select("row", "owner", "repo", F.explode(F.concat("_base", "_candidates")).alias("s"))
            .select("row", "owner", "repo", F.struct("s.start", "s.kind", "s.end").alias("span"),
                    F.sha2(value, 256).alias("hash")))
    counted = frequencies(held, found.select("owner", "repo"), max_repos, max_share)
    seen = held.select("row", "span", "hash").join(counted, "hash")
    spread = F.col("spread")
    copied = (F.col("n_owners") >= copied_owners) | spread
    based = F.col("span.kind") < 3
    judged = seen.groupBy("row").agg(
        F.collect_list(F.when(~based & (F.col("n_owners") <= max_owners) & ~spread, F.col("span"))).alias("added"),
        F.sum((based & copied).cast("long")).alias("n_copied"),
        F.sum((based & ~copied).cast("long")).alias("n_live"))
    bare = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                   s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (found.join(judged, "row", "left")
            .select(*[F.col(f"k_{n}").alias(n) for n in keep], bare.alias("base"),
                    F.array_sort(F.concat(bare, F.coalesce("added", none))).alias("spans"),
                    F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
                    F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live")))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """``text`` with every span replaced; spans that overlap are replaced as one."""
    ends = F.transform(spans, lambda s: s["end"])

    def piece(s: Column, i: Column) -> Column:
        done = F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0))
        return F.when(s["start"] >= done, F.concat(F.substring(text, done + 1, s["start"] - done), F.lit(mask))
                      ).otherwise("")

    rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(spans, piece), ""), rest)).otherwise(text)


def mask_secrets(df: DataFrame, text_col: str, owner_col: str, repo_col: str, mask: str = "[secret]") -> DataFrame:
    """``df`` with the secrets of its texts masked; all other columns and rows as they are."""
    names = [c for c in df.columns if c != text_col]
    keep = {f"c{i}": c for i, c in enumerate(df.columns)}
    back = {c: n for n, c in keep.items()}
    out = scan_secrets(df, text_col, owner_col, repo_col, keep)
    text = masked(F.col(back[text_col]), F.col("spans"), mask)
    return out.select(*[(F.col(back[c]) if c in names else text).alias(c) for c in df.columns])
