"""Merkle manifest of a dataset by lag and lead windows.

Every row is a leaf, and eight neighbours of a language make a node of the next level. A level is one
window pass over runs of ``FANOUT`` rows: lag and lead columns of fixed offsets, masked by a row's
slot and its run's length, hold the siblings, and the first child of a run hashes the parent. Going down again, each
node's siblings are put before its parent's, so a row gets its whole proof from the table above its own.
A window never holds more than one run, however many rows a language has.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, saved, without

FANOUT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
OWN = ["leaf", "subroot", "root", "proof"]
_G, _P, _N, _Q, _H, _ID, _L, _R = (f"_nextdist_{x}" for x in ("group", "place", "nodes", "run", "hash", "id", "left", "right"))
_EMPTY = "cast(array() as array<struct<left: string, right: string>>)"


def digest(*parts: str | Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(c: str | Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read alike; ``-`` for null."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(fields: list[str | Column] = FIELDS) -> Column:
    """The leaf of a row."""
    return digest(*map(field, fields))


def folded(leaf: str | Column, proof: str | Column) -> Column:
    """The root that a leaf and the siblings on its way lead to."""
    return F.aggregate(proof, F.col(leaf) if isinstance(leaf, str) else leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(proof: str | Column) -> Column:
    """One digest of all siblings of a proof, level by level, left to right."""
    return digest(F.aggregate(proof, F.lit(""), lambda a, s: F.concat(a, s["left"], s["right"])))


def _with_siblings(x: DataFrame, fanout: int) -> DataFrame:
    """Add the hashes before and after a node in its run, each as one string, and the number of the run."""
    x = x.withColumn(_Q, F.expr(f"{_P} div {fanout}"))
    slot = F.col(_P) % fanout
    length = F.least(F.lit(fanout), F.col(_N) - F.col(_Q) * fanout)
    w = W.partitionBy(_G, _Q).orderBy(_P)
    left = [F.when(slot >= i, F.lag(_H, i).over(w)) for i in range(fanout - 1, 0, -1)]
    right = [F.when(slot + i < length, F.lead(_H, i).over(w)) for i in range(1, fanout)]
    return x.withColumn(_L, F.concat_ws("", *left)).withColumn(_R, F.concat_ws("", *right))


def _levels(leaves: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The tables of all levels of groups of ``most`` nodes at most, the last with one node per group. A group that is one node already stays so."""
    tables = [leaves]
    while most > 1 or len(tables) == 1:
        x = _with_siblings(tables[-1].select(_G, _P, _N, _H), fanout).where(F.col(_P) % fanout == 0)
        parent = F.when(F.col(_N) == 1, F.col(_H)).otherwise(digest(_H, _R))
        tables.append(saved(x.select(_G, F.col(_Q).alias(_P), F.expr(f"({_N} + {fanout - 1}) div {fanout}").alias(_N), parent.alias(_H)), "merkle-level"))
        most = -(-most // fanout)
    return tables


def _proofs(tables: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The rows of the first table with ``proof`` and ``subroot``, from those of the last table's nodes, ``tops``."""
    above = tops
    for k in range(len(tables) - 2, -1, -1):
        x = _with_siblings(tables[k], fanout)
        up = above.select(_G, F.col(_P).alias(_Q), "subroot", F.col("proof").alias("_nextdist_up"))
        # runs are dealt by the same keys for the windows and for the join
        x = x.join(up, [_G, _Q])
        mine = F.when(F.col(_N) > 1, F.array(F.struct(F.col(_L).alias("left"), F.col(_R).alias("right")))).otherwise(F.expr(_EMPTY))
        x = x.select(*tables[k].columns, "subroot", F.concat(mine, "_nextdist_up").alias("proof"))
        above = x if k == 0 else saved(x.select(_G, _P, "subroot", "proof"), "merkle-proofs")
    return above


def merkle_manifest(docs: DataFrame, keep: list[str] | None = None, fields: list[str] | None = None, group: str = "lang", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """The tree over all rows of ``docs``, one row of it per leaf.

    Adds ``leaf`` (the row's hash, of its ``fields``), ``subroot`` (of its ``group``), ``root`` (of all groups' subroots in
    bytewise order, null first) and ``proof`` (an array of ``(left, right)``: the siblings' hashes on the way to the root) to the
    columns ``keep`` (default: ``order``). :func:`folded` gives the root again from a leaf and its proof.

    Texts are read once; only hashes are shuffled. Nulls: a null field is a value of its own, a null group comes first, and so do
    rows without ``order``. Rows of equal ``order`` stand by their leaf; repeated rows are leaves each. An empty table has an empty
    manifest. Input columns named like a result are replaced, others don't matter. Texts of any length are hashed whole.
    """
    keep = [c for c in ([order] if keep is None else keep) if c.lower() not in OWN]
    leaf = leaf_of([F.col(f"`{c}`") for c in fields or FIELDS])
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, then bytewise
    x = without(docs, [c for c in OWN if c not in (fields or FIELDS) and c not in (group, order)])
    x = saved(x.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{order}`").alias(_ID), key.alias(_G), leaf.alias(_H)), "merkle-leaves")
    x = numbered(x, [F.col(_G), F.col(_ID).asc_nulls_first(), F.col(_H)], "_nextdist_at", "merkle-order").drop(_ID)
    sizes = x.groupBy(_G).agg(F.min("_nextdist_at").alias("_nextdist_first"), F.count("*").alias(_N))
    sizes = saved(sizes, "merkle-groups")
    x = x.join(sizes, _G).withColumn(_P, F.col("_nextdist_at") - F.col("_nextdist_first")).drop("_nextdist_at", "_nextdist_first")
    most = sizes.agg(F.max(_N)).first()[0] or 0
    tables = _levels(x, most, fanout)

    subs = numbered(tables[-1].select(F.col(_G).alias("_nextdist_of"), _H), [F.col("_nextdist_of")], _P, "merkle-subroots")
    n = subs.count()
    subs = subs.select(F.lit("").alias(_G), _P, F.lit(n).cast("long").alias(_N), _H, "_nextdist_of")
    above = _levels(subs, n, fanout)
    root = above[-1].first()
    tops = above[-1].select(_G, _P, F.lit("").alias("subroot"), F.expr(_EMPTY).alias("proof"))
    tops = _proofs(above, tops, fanout).select(F.col("_nextdist_of").alias(_G), F.lit(0).cast("long").alias(_P), F.col(_H).alias("subroot"), "proof")
    x = _proofs(tables, saved(tops, "merkle-subroots"), fanout)
    return x.select(*[F.col(f"`{c}`") for c in keep], F.col(_H).alias("leaf"), "subroot", F.lit(root[_H] if root else None).cast("string").alias("root"), "proof")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest's digest columns of ``documents``, held against a copy in which every third row's text has lost its capitals.

    ``folded_root`` is made from the copy's leaf and the manifest's siblings, ``verified`` tells whether it is the root. A null text
    stays null and a row without an id is not tampered with.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    copy = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    x = docs.select(*FIELDS, leaf_of(["doc_id", "source", "lang", "n_chars", copy]).alias("_nextdist_copy"))
    x = merkle_manifest(x, keep=["doc_id", "_nextdist_copy"]).withColumn("folded_root", folded("_nextdist_copy", "proof"))
    return x.select("doc_id", "leaf", "subroot", "root", proof_digest("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(depth: int = 8, above: int = 4) -> str:
    """All levels up to 8 ** ``depth`` rows of a language and 8 ** ``above`` languages."""
    enc = lambda c: f"coalesce(octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in FIELDS[:-1]) + f" || {enc(text)})"
    crc = (
        "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), "
        "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"
    )
    out = [
        f"d as (select row_number() over () as r, *, case when doc_id is not null and {crc} % 3 = 0 then translate(text, '{UPPER}', '{LOWER}') else text end as copy from documents)",
        f"x as (select r, doc_id, lang, {leaf('text')} as leaf, {leaf('copy')} as changed from d)",
        f"l0 as materialized (select *, count(*) over (partition by g) as n from (select r, coalesce('=' || lang, '') as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as p, leaf as h from x))",
    ]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            out.append(f"{name}r{k} as materialized (select g, p // {FANOUT} as q, list(h order by p) as hs, any_value(n) as n from {name}{k} group by all)".replace("group by all", f"group by g, p // {FANOUT}"))
            out.append(f"{name}{k + 1} as materialized (select g, q as p, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h, (n + {FANOUT - 1}) // {FANOUT} as n from {name}r{k})")

    tree("l", depth)
    out.append(f"s0 as materialized (select '' as g, g as of, row_number() over (order by g) - 1 as p, h, count(*) over () as n from l{depth})")
    tree("s", above)

    def climb(name: str, at: str, levels: int, first: int, base: str) -> list[str]:
        """Steps of fold and proof, one table each."""
        made = []
        for k in range(levels):
            slot = f"({at} // {FANOUT**k}) % {FANOUT}"
            left, right = f"array_to_string(t.hs[1:{slot}], '')", f"array_to_string(t.hs[{slot} + 2:], '')"
            made.append(
                f"c{first + k + 1} as (select c.* exclude (fold, proof), case when t.n = 1 then fold else sha256({left} || fold || {right}) end as fold, "
                f"case when t.n = 1 then proof else proof || {left} || {right} end as proof from c{first + k} c join {name}r{k} t on t.g = {base} and t.q = {at} // {FANOUT ** (k + 1)})"
            )
        return made

    out.append(f"c0 as (select x.doc_id, x.leaf, l0.g, l0.p, s0.p as sp, s0.h as subroot, x.changed as fold, '' as proof from x join l0 using (r) join s0 on s0.of = l0.g)")
    out += climb("l", "c.p", depth, 0, "c.g")
    out += climb("s", "c.sp", above, depth, "''")
    last = depth + above
    return "with " + ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, fold as folded_root, fold = root as verified from c{last}, (select h as root from s{above})"


ORACLE_SQL = _oracle()
