"""The stand-in tables of ``fixtures`` as DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

import re


def hash_sql(seed: int, key: str) -> str:
    """The 32-bit hash of ``functions.hash_bucket``."""
    return f"(('0x' || substr(md5(concat('{seed}:', cast({key} as varchar))), 1, 8))::BIGINT)"


def unit_sql(seed: int, key: str) -> str:
    """The hash scaled to [0, 1)."""
    return f"(cast({hash_sql(seed, key)} as double) / 4294967296.0::double)"


def _id(prefix: str, key: str) -> str:
    return f"concat('{prefix}', {_padded(key, 16)})"


def _padded(key: str, width: int) -> str:
    digits = f"cast({key} as varchar)"
    return f"lpad({digits}, cast(greatest(length({digits}), {width}) as int), '0')"


def pair_sql(user: str = "user_id", song: str = "song_id") -> str:
    """The key of ``sampling.key_of`` for two strings."""
    return " || ".join(f"coalesce(concat(length({c}), ':', {c}), '-')" for c in (user, song))


_PAIR = (
    f"concat('<', {_id('SO', 'p_partkey')}, ' ', {_id('TR', 'p_partkey')}, '> ', p_brand, "
    "'  -  ', p_name, '  !=  ', p_type, '  -  ', p_name)"
)
_FEATURES = ", ".join(f"cast(embedding[{i}] as double) as f{i}" for i in range(1, 65))
_LINE = r"^(?:< )?ERROR: <(\S{18}) (\S{18})> (.*?)  -  (.*?)  !=  (.*?)  -  (.*)$"
_FIELDS = ("song_id", "track_id", "song_artist", "song_title", "track_artist", "track_title")
_PARSED = ", ".join(
    f"regexp_extract(value, '{_LINE}', {i}) as {name}" for i, name in enumerate(_FIELDS, 1)
)

# In order: a view may use those before it.
VIEWS = {
    "triplets": (
        f"select concat('U', {_padded('o_custkey', 8)}) as user_id, "
        f"{_id('SO', 'l_partkey')} as song_id, cast(sum(l_quantity) as int) as plays "
        "from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey"
    ),
    "mismatch_lines": (
        f"select concat(case when p_size > 40 then 'ERROR: ' else 'checked: ' end, {_PAIR}) as value from part"
    ),
    "accepted_lines": (
        "select concat(case when p_size > 45 then '< ERROR: ' when p_size < 5 then '> ERROR: ' "
        f"else 'note ' end, {_PAIR}) as value from part"
    ),
    "mismatches": f"select {_PARSED} from mismatch_lines where starts_with(value, 'ERROR: ')",
    "accepted": f"select {_PARSED} from accepted_lines where starts_with(value, '< ERROR: ')",
    "metadata": (
        f"select {_id('SO', 'p_partkey')} as song_id, {_id('TR', 'p_partkey')} as track_id, "
        "p_brand as artist_name, p_name as title, p_type as release, "
        "case when p_size > 42 then null else cast(p_size as double) / 50 end as song_hotttnesss from part"
    ),
    "features": f"select concat(chr(39), {_id('TR', 'vec_id')}, chr(39)) as MSD_TRACKID, {_FEATURES} from embeddings",
    "genres": (
        "select track_id, case "
        f"when {hash_sql(1, 'vec_id')} % 100 < 5 then 'Pop_Rock' "
        "when s > 0.22 then 'Electronic' when s > 0.1 then 'Rap' when s > 0 then 'Jazz' "
        f"else 'Pop_Rock' end as genres from (select vec_id, {_id('TR', 'vec_id')} as track_id, "
        "cast(embedding[1] as double) + cast(embedding[2] as double) as s from embeddings) x"
    ),
    "tagged": (
        "select replace(MSD_TRACKID, chr(39), '') as track, "
        + ", ".join(f"f{i}" for i in range(1, 65))
        + ", genres.genres from features join genres on replace(MSD_TRACKID, chr(39), '') = track_id"
    ),
    "binary_tagged": (
        "select track, "
        + ", ".join(f"f{i}" for i in range(1, 65))
        + ", case when genres = 'Electronic' then 'Electronic' else 'Other' end as genres from tagged"
    ),
    "judged": (
        "select l_orderkey, l_linenumber, l_quantity, l_extendedprice as score, "
        "case when l_returnflag = 'R' then 1.0::double else 0.0::double end as label, "
        "case when l_quantity > 25 then 1.0::double else 0.0::double end as prediction from lineitem"
    ),
    "judged_classes": (
        "select case l_returnflag when 'A' then 0.0::double when 'N' then 1.0::double else 2.0::double end as label, "
        "case when l_linestatus = 'F' and l_quantity < 20 then 0.0::double "
        "when l_linestatus = 'F' then 1.0::double when l_quantity < 40 then 2.0::double "
        "else 3.0::double end as prediction from lineitem"
    ),
    "scored": (
        "select t.user_id, t.song_id, t.plays, "
        "case when s.total % 97 = 0 then 'NaN'::double else cast(s.total as double) / 1000 end as prediction "
        "from triplets t join (select song_id, cast(sum(plays) as bigint) as total from triplets group by song_id) s "
        "on t.song_id = s.song_id"
    ),
}


def with_views(sql: str) -> str:
    """Put the views a statement uses, and those they use, in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql.strip()
    views = ",\n".join(f"{n} as ({VIEWS[n]})" for n in VIEWS if n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {views},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {views},\n{body[5:]}"
    return f"with {views}\n{body}"
