"""The damaged columns of the loads as SQL, for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.operators.quality_profile import GRID


def damaged(numbers: Sequence[str], days: Sequence[str], texts: Sequence[str], z: float = 6.0, floor: float = 0.10, ks: float = 3.0, form_floor: float = 0.25) -> str:
    """`load_id, column_name` of the columns that depart in one load; numeric,
    date and text columns of `crash_events` are named."""
    named = lambda names: "[" + ", ".join(f"'{c}'" for c in names) + "]"
    num = ", ".join([f"CASE WHEN isnan({c}::DOUBLE) THEN NULL ELSE {c}::DOUBLE END" for c in numbers] + [f"({c} - DATE '1970-01-01')::DOUBLE" for c in days])
    txt = ", ".join(f"CASE WHEN trim({c}::VARCHAR) <> '' THEN {c}::VARCHAR END" for c in texts)
    decimals = "CASE " + " ".join(f"WHEN abs(x * 1e{k}::DOUBLE - round(x * 1e{k}::DOUBLE)) <= abs(x * 1e{k}::DOUBLE) * 1e-12 THEN '{k}'" for k in range(6)) + " ELSE '6' END"
    form = r"regexp_replace(regexp_replace(regexp_replace(s, '\p{Lu}+', 'A', 'g'), '\p{Ll}+', 'a', 'g'), '[0-9]+', '9', 'g')"
    limit = lambda p, n: f"greatest({floor}, {z} * sqrt(least(greatest({p}, 0.01), 0.99) * (1 - least(greatest({p}, 0.01), 0.99)) / {n}))"
    edges = ", ".join(f"{i / GRID}" for i in range(1, GRID))
    key = "load_id, column_name"
    return f"""WITH u AS (SELECT load_id, unnest({named([*numbers, *days])}) column_name, unnest([{num}]) x, NULL::VARCHAR s FROM crash_events
  UNION ALL SELECT load_id, unnest({named(texts)}), NULL, unnest([{txt}]) FROM crash_events),
lv AS (SELECT {key}, x, s, count(*) n, x IS NOT NULL OR s IS NOT NULL present FROM u WHERE load_id IS NOT NULL GROUP BY ALL),
ld AS (SELECT {key}, sum(n)::DOUBLE n, coalesce(sum(n) FILTER (present), 0)::DOUBLE np, count(*) FILTER (present) nd, coalesce(sum(n) FILTER (x IS NOT NULL), 0)::DOUBLE nx FROM lv GROUP BY ALL),
ba AS (SELECT *, sum(n) OVER c - n o_n, sum(np) OVER c - np o_np, sum(nx) OVER c - nx o_nx, nd / nullif(np, 0) ratio, median(nd / nullif(np, 0)) OVER c usual FROM ld WINDOW c AS (PARTITION BY column_name)),
missing AS (SELECT {key} FROM ba WHERE o_n > 0 AND abs(o_np / o_n - np / n) > {limit('(1 - o_np / o_n)', 'n')}),
differing AS (SELECT {key} FROM ba WHERE np >= 20 AND abs(ratio - usual) > 0.15),
tv AS (SELECT column_name, x, s, sum(n) sn FROM lv WHERE present GROUP BY ALL),
co AS (SELECT lv.load_id, lv.column_name, lv.n / np own, (sn - lv.n) / o_np other, np FROM lv JOIN ba USING ({key}) JOIN tv ON tv.column_name = lv.column_name AND tv.x IS NOT DISTINCT FROM lv.x AND tv.s IS NOT DISTINCT FROM lv.s WHERE lv.present AND np >= 20 AND o_np > 0),
coded AS (SELECT {key} FROM co WHERE own - other > {limit('other', 'np')}),
ed AS (SELECT column_name, unnest(quantile_disc(x, [{edges}])) e, unnest(range(1, {GRID})) i FROM lv WHERE x IS NOT NULL GROUP BY column_name),
cu AS (SELECT lv.load_id, lv.column_name, i, coalesce(sum(n) FILTER (x <= e), 0) c FROM lv JOIN ed USING (column_name) WHERE x IS NOT NULL GROUP BY ALL),
moved AS (SELECT {key} FROM (SELECT *, sum(c) OVER (PARTITION BY column_name, i) - c o FROM cu) JOIN ba USING ({key}) WHERE nx >= 20 AND o_nx > 0 GROUP BY {key}, nx HAVING max(abs(c / nx - o / o_nx)) * sqrt(nx) > {ks}),
fo AS (SELECT {key}, CASE WHEN x IS NOT NULL THEN {decimals} ELSE {form} END f, sum(n) n FROM lv WHERE present GROUP BY ALL),
formed AS (SELECT {key} FROM (SELECT *, sum(n) OVER (PARTITION BY column_name, f) - n o FROM fo) JOIN (SELECT {key}, np, o_np FROM ba) USING ({key}) WHERE np >= 20 AND o_np > 0 GROUP BY {key} HAVING sum(greatest(n / np - o / o_np, 0)) > {form_floor})
SELECT * FROM missing UNION SELECT * FROM differing UNION SELECT * FROM coded UNION SELECT * FROM moved UNION SELECT * FROM formed"""
