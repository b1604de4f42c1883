"""The digest as relational SQL: no kernel, windows and folds only, for Spark and for DuckDB.

It states the digest in closed form (rolling values of seven bytes, ends of pieces by level, folds over pieces), and so is
a second formulation to check the kernel with, and the text of the queries' SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from blockprint.constants import ALPHABET, FNV_FACTOR, FNV_START


@dataclass(frozen=True)
class Dialect:
    bytes_: str  # of {table}, {key}, {data}: rows (id, i, c)
    xor: str
    shift: str
    div: str
    lowest_bit: str  # the number of zero bits below the lowest one bit of q
    levels: str
    fold: str
    join: str
    substring: str = "substr({0}, {1}, 1)"


SPARK = Dialect(
    bytes_="SELECT id, p + 1 AS i, cast(conv(x, 16, 10) AS bigint) AS c FROM (SELECT {key} AS id, posexplode(regexp_extract_all(hex(cast({data} AS binary)), '(..)', 1)) AS (p, x) FROM {table})",
    xor="({0} ^ {1})",
    shift="shiftleft({0}, {1})",
    div="({0} div {1})",
    lowest_bit="least(30, bit_count((q & -q) - 1))",
    levels="(SELECT id AS k FROM range(0, 31))",
    fold="aggregate(transform(array_sort(collect_list(struct(i, c))), x -> x.c), cast({start} AS bigint), (s, x) -> ((s * {factor}) % 64) ^ (x & 63))",
    join="array_join(transform(array_sort(collect_list(struct(p, ch))), x -> x.ch), '')",
)
DUCKDB = Dialect(
    bytes_="SELECT id, generate_subscripts(h, 1) AS i, cast('0x' || unnest(h) AS bigint) AS c FROM (SELECT {key} AS id, regexp_extract_all(hex(encode({data})), '..') AS h FROM {table})",
    xor="xor({0}, {1})",
    shift="({0} << {1})",
    div="({0} // {1})",
    lowest_bit="least(30, bit_count((q & -q) - 1))",
    levels="(SELECT unnest(range(0, 31)) AS k)",
    fold="list_reduce(list_prepend(cast({start} AS bigint), list(c ORDER BY i)), lambda s, x: xor((s * {factor}) % 64, x & 63))",
    join="string_agg(ch, '' ORDER BY p)",
)


def rolled(d: Dialect, table: str, key: str, data: str) -> str:
    """CTEs bytes_ (id, i, c) and rolls (id, i, roll), ends_ (id, i, level) and sizes (id, n, moving)."""
    over = "OVER (PARTITION BY id ORDER BY i{frame})"
    plain = "sum(c) " + over.format(frame=" ROWS BETWEEN 6 PRECEDING AND CURRENT ROW")
    back = [f"lag(c, {j}, 0) " + over.format(frame="") if j else "c" for j in range(7)]
    weighted = " + ".join(f"{7 - j} * {x}" for j, x in enumerate(back))
    mixed = "c"
    for j in range(1, 7):
        mixed = d.xor.format(mixed, d.shift.format(f"cast({back[j]} AS bigint)", 5 * j))
    return f"""bytes_ AS ({d.bytes_.format(table=table, key=key, data=data)}),
rolls AS (SELECT id, i, (cast({plain} AS bigint) + cast({weighted} AS bigint) + ({mixed} & 4294967295)) & 4294967295 AS roll FROM bytes_),
ends_ AS (SELECT id, i, {d.lowest_bit} AS level FROM (SELECT id, i, {d.div.format("(roll + 1)", "3")} AS q FROM rolls WHERE (roll + 1) % 3 = 0) AS e),
sizes AS (SELECT r.id AS id, r.i AS n, r.roll <> 0 AS moving FROM rolls r JOIN (SELECT id, max(i) AS m FROM rolls GROUP BY id) AS l ON r.id = l.id AND r.i = l.m),
counts AS (SELECT id, k, count(*) AS pieces FROM ends_ CROSS JOIN {d.levels} AS ks WHERE k <= level GROUP BY id, k),
chosen AS (SELECT s.id AS id, s.n AS n, s.moving AS moving, coalesce(max(CASE WHEN c.pieces >= 32 AND (c.k = 0 OR {d.shift.format("cast(192 AS bigint)", "(c.k - 1)")} < s.n) THEN c.k END), 0) AS log FROM sizes s LEFT JOIN counts c ON s.id = c.id GROUP BY s.id, s.n, s.moving)"""


def digest_sql(d: Dialect, table: str, key: str, data: str, long: bool = False, where: str = "true") -> str:
    """SELECT of id, log_block_size, bh1, bh2 for every row of table (key must tell them apart)."""
    half = 63 if long else 31
    if d is SPARK:
        return folded_digest_sql(table, key, data, half, where)
    fold = d.fold.format(start=FNV_START, factor=FNV_FACTOR)
    letter = lambda v: d.substring.format(f"'{ALPHABET}'", f"({v}) + 1")
    return f"""WITH {rolled(d, f"(SELECT * FROM {table} WHERE {where}) AS src", key, data)},
parts AS (SELECT id, n, moving, log + w AS at, w, CASE WHEN w = 0 THEN 63 ELSE {half} END AS most FROM chosen CROSS JOIN (SELECT 0 AS w UNION ALL SELECT 1 AS w) AS ws),
marks AS (SELECT p.id AS id, p.w AS w, e.i AS i, row_number() OVER (PARTITION BY p.id, p.w ORDER BY e.i) AS r, p.most AS most FROM parts p JOIN ends_ e ON p.id = e.id AND e.level >= p.at),
totals AS (SELECT p.id AS id, p.w AS w, p.most AS most, p.n AS n, p.moving AS moving, count(m.i) AS pieces, max(m.i) AS final FROM parts p LEFT JOIN marks m ON p.id = m.id AND p.w = m.w GROUP BY p.id, p.w, p.most, p.n, p.moving),
placed AS (SELECT b.id AS id, t.w AS w, b.i AS i, b.c AS c, t.most AS most, t.pieces AS pieces, t.n AS n, t.moving AS moving, t.final AS final,
  coalesce(sum(CASE WHEN m.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY b.id, t.w ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
  FROM bytes_ b JOIN totals t ON b.id = t.id LEFT JOIN (SELECT * FROM marks WHERE r <= most) AS m ON b.id = m.id AND t.w = m.w AND b.i = m.i),
letters AS (SELECT id, w, p, {letter(fold)} AS ch FROM placed
  WHERE p < least(pieces, most) OR (p = least(pieces, most) AND (moving OR (pieces > most AND i <= final))) GROUP BY id, w, p
  UNION ALL SELECT id, w, pieces AS p, {letter(FNV_START)} AS ch FROM totals WHERE moving AND pieces <= most AND final = n),
strings AS (SELECT id, w, {d.join} AS s FROM letters GROUP BY id, w),
keys_ AS (SELECT {key} AS id FROM {table} WHERE {where})
SELECT k.id AS id, cast(coalesce(c.log, 0) AS int) AS log_block_size, coalesce(a.s, '') AS bh1, coalesce(b.s, '') AS bh2
FROM keys_ k LEFT JOIN chosen c ON k.id = c.id LEFT JOIN strings a ON k.id = a.id AND a.w = 0 LEFT JOIN strings b ON k.id = b.id AND b.w = 1"""


#: Bytes whose rolling values one step of folded_digest_sql() holds.
STEP = 4096


def folded_digest_sql(table: str, key: str, data: str, half: int, where: str) -> str:
    """digest_sql() for Spark, as folds over each text by itself: rows of single bytes would be shuffled, sorted and joined.

    Ends of pieces are numbers, place * 32 + level, found a step of bytes at a time. What is used more than once, or in a
    loop, is bound to a name by let(), as Spark computes a column again wherever it puts it.
    """
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    codes = lambda x: f"transform(split(decode({x}, 'ISO-8859-1'), ''), b -> ascii(b))"
    back = lambda last, j: f"{last} - {j}" if j else last

    def roll(last: str) -> str:
        """The rolling value whose last byte is p[last]."""
        sums = " + ".join(f"{8 - j} * p[{back(last, j)}]" for j in range(7))
        mixed = " ^ ".join(f"shiftleft(p[{back(last, j)}], {5 * j})" if j else f"p[{last}]" for j in range(7))
        return f"((cast({sums} AS bigint) + (cast({mixed} AS bigint) & 4294967295)) & 4294967295)"

    rolls = f"transform(slice(p, 7, {STEP}), (c, i) -> shiftleft(s + i + 1, 32) | {roll('i + 6')})"
    level = let("q", "((r & 4294967295) + 1) div 3", "least(30, bit_count((q & -q) - 1))")
    ends = f"transform(filter({rolls}, r -> ((r & 4294967295) + 1) % 3 = 0), r -> shiftright(r, 32) * 32 + {level})"
    all_ends = f"flatten(transform(sequence(0L, n, {STEP}L), s -> {let('p', codes(f'substring(d, cast(s AS int) + 1, {STEP + 6})'), ends)}))"
    # Level by level, up to the guess from the size, while 32 ends are left.
    more = let("f", "filter(a.ends, e -> (e & 31) >= k)", "if(size(f) >= 32, named_struct('log', k, 'ends', f), a)")
    guess = "size(filter(sequence(0, 29), k -> shiftleft(192L, k) < n))"
    chosen = f"aggregate(slice(sequence(1, 30), 1, {guess}), named_struct('log', 0, 'ends', {all_ends}), (a, k) -> {more})"
    moving = f"if(n > 0, {let('p', codes('substring(d, -7, 7)'), roll('6'))} <> 0, false)"

    def string(places: str, most: int) -> str:
        """A character for each piece that is ended, and for what follows."""
        tail = f"CASE WHEN moving THEN array(n) WHEN size(m) > {most} THEN array(element_at(m, -1)) ELSE array() END"
        piece = "substring(d, cast(lo AS int) + 7, cast(t[i] - lo AS int))"
        fold = f"aggregate(filter(split(decode({piece}, 'ISO-8859-1'), ''), b -> b <> ''), {FNV_START}, (h, b) -> ((h * {FNV_FACTOR}) ^ ascii(b)) & 63)"
        letters = f"transform(t, (e, i) -> substr('{ALPHABET}', {let('lo', 'if(i = 0, 0L, t[greatest(i - 1, 0)])', fold)} + 1, 1))"
        return let("m", places, let("t", f"concat(slice(m, 1, {most}), {tail})", f"array_join({letters}, '')"))

    first = string("transform(x.ends, e -> shiftright(e, 5))", 63)
    second = string("transform(filter(x.ends, e -> (e & 31) > x.log), e -> shiftright(e, 5))", half)
    whole = let("x", chosen, let("moving", moving, f"named_struct('log_block_size', x.log, 'bh1', {first}, 'bh2', {second})"))
    bound = let("d", f"concat(x'000000000000', coalesce(cast({data} AS binary), x''))", let("n", "cast(octet_length(d) - 6 AS bigint)", whole))
    return f"SELECT id, h.* FROM (SELECT {key} AS id, explode(array({bound})) AS h FROM {table} WHERE {where})"


def trigger_counts_sql(d: Dialect, table: str, key: str, data: str) -> str:
    """id, level, pieces: how many pieces a text has at each level that ends any."""
    return f"WITH {rolled(d, table, key, data)} SELECT id, cast(k AS int) AS level, pieces FROM counts"
