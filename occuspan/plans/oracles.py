"""The registered queries once more, as SQL over the same tables.

Written independently of the DataFrame code: stays are found by looking for
neighbouring sightings, regions by unnesting, the comparison by list functions.
"""

from __future__ import annotations

from occuspan.functions.geo import FINEST_CELL, KEY_BITS
from occuspan.functions.labels import CATEGORY_SYMBOLS, OTHER_CATEGORY_SYMBOL
from occuspan.plans.inputs import BASE_YEAR, GROUP_CODES, HALF_WIDTHS, ROW_LIMITS, SEARCH_TERMS
from occuspan.plans.queries import ONE_BOX, PLACE_COUNT_RANGE, TENURE_RANGE

_LIST = ", ".join


def _label(q: str) -> str:
    return f"(({BASE_YEAR} + {q} // 4)::VARCHAR || 'Q' || ({q} % 4 + 1)::VARCHAR)"


def _clean_name(name: str, branch: str) -> str:
    bare = rf"regexp_replace(lower(concat({name}, {branch})), '\(주\)|\(유\)|㈜|주식회사|유한회사', '', 'g')"
    return rf"""regexp_replace({bare}, '[\t\n\f\r ()（）\-_.,''"㈜·&]+', '', 'g')"""


_FLOOR = "coalesce(nullif(trim(flr), ''), '미상')"
_SHOWN = "coalesce(nullif(shop, ''), '(상호없음)') || coalesce(' ' || nullif(branch, ''), '')"
_MONTH = f"({BASE_YEAR} + qord // 4)::VARCHAR || lpad(((qord % 4 + 1) * 3)::VARCHAR, 2, '0')"
_LATE = rf"(regexp_matches(substr(store_id, 7, 6), '^\d{{6}}$') AND substr(store_id, 7, 6) > {_MONTH})"
_BAD_POINT = "coalesce(try_cast(lng_text AS DOUBLE) = 0, TRUE) OR try_cast(lat_text AS DOUBLE) IS NULL"
_UNUSABLE = f"(coalesce(trim(bld), '') = '' OR {_BAD_POINT})"


def _tenth(value: str) -> str:
    return f"floor(({value}) * 10 + 0.5) / 10::DOUBLE"


def _flat(length: int) -> str:
    shown = "list_concat(coalesce(shown_a, []), coalesce(shown_b, []))"
    return f"""
        SELECT any_value(sigungu) AS sigungu, any_value(road_address) AS road_address, any_value(floor_label) AS floor_label,
          place_key, chunk, any_value(dong) AS dong,
          CASE chunk WHEN 0 THEN coalesce(any_value(n_a), 0) END AS n_a, CASE chunk WHEN 0 THEN coalesce(any_value(n_b), 0) END AS n_b,
          coalesce(string_agg(display, ' / ' ORDER BY display) FILTER (list_contains(shown_a, display)), '') AS display_a,
          coalesce(string_agg(display, ' / ' ORDER BY display) FILTER (list_contains(shown_b, display)), '') AS display_b,
          CASE WHEN chunk = 0 AND any_value(n_a) > 0 AND any_value(n_b) > 0 THEN any_value(survived) END AS survived,
          any_value(verdict) AS verdict
        FROM (SELECT *, ((row_number() OVER (PARTITION BY place_key ORDER BY display) - 1) // {length})::INTEGER AS chunk
              FROM (SELECT *, unnest(list_distinct({shown})) AS display FROM compared))
        GROUP BY place_key, chunk"""


def _details(length: int) -> str:
    return f"""
        SELECT place_key, page, count(seq)::INTEGER AS entries, string_agg(category_code, ',' ORDER BY seq) AS codes,
          string_agg(coalesce(end_quarter, '-'), ',' ORDER BY seq) AS ends, any_value(turnover_count) AS turnover_count,
          any_value(r.region_name) AS dong_name, any_value(r.turnover_avg) AS dong_turnover_avg
        FROM (SELECT place_key, turnover_count, dong_code FROM places) p
        LEFT JOIN (SELECT *, ((seq - 1) // {length})::INTEGER AS page FROM history) h USING (place_key)
        LEFT JOIN regions r ON r.region_level = 'dong' AND r.region_code = dong_code GROUP BY place_key, page"""


def _documents(length: int) -> str:
    return f"""
        SELECT place_key, page, any_value(floor_label) AS floor_label, arg_max(category_code, seq) AS newest_code,
          count(*)::INTEGER AS entries, any_value(dong_code) AS dong_code
        FROM places JOIN keys USING (place_key) JOIN (
          SELECT place_key, category_code, seq, ((max(seq) OVER (PARTITION BY place_key) - seq) // {length})::INTEGER AS page
          FROM history) USING (place_key)
        GROUP BY place_key, page"""


_CTES = {
    "line": f"""
        SELECT l_suppkey AS s, l_orderkey AS k, l_linenumber AS ln, year(l_shipdate) AS y,
               ((year(l_shipdate) - {BASE_YEAR}) * 4 + quarter(l_shipdate) - 1)::INTEGER AS q,
               regexp_extract(p_brand, '(\\d+)', 1)::INTEGER AS b, p_brand, p_type, p_size,
               n_nationkey, n_name, r_regionkey, r_name, n_nationkey || '-' || (l_suppkey % 3) AS district
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "raw": f"""
        SELECT q AS qord,
          'MA' || lpad((s % 10000)::VARCHAR, 4, '0')
            || CASE WHEN k % 211 = 0 THEN '209912' ELSE (y - y % 2) || '01' END || lpad(b::VARCHAR, 2, '0')
            || CASE WHEN s >= 10000 THEN (s // 10000)::VARCHAR ELSE '' END AS store_id,
          CASE WHEN k % 53 = 0 THEN NULL WHEN k % 5 = 0 THEN '(주) ' || p_brand
               WHEN k % 5 = 1 THEN upper(p_brand) ELSE p_brand END AS shop,
          CASE WHEN b % 3 = 0 AND k % 53 <> 0 THEN 'No.' || (s % 4) END AS branch,
          CASE WHEN k % 61 <> 0 THEN [{_LIST(f"'{c}'" for c in GROUP_CODES)}][b % {len(GROUP_CODES)} + 1]
               || lpad((p_size % 7)::VARCHAR, 3, '0') END AS cat,
          CASE WHEN k % 67 <> 0 THEN p_type END AS catname,
          r_regionkey::VARCHAR AS sido, r_name AS sidoname,
          CASE WHEN k % 71 <> 0 THEN n_nationkey::VARCHAR END AS sgg, n_name AS sggname,
          CASE WHEN k % 73 <> 0 THEN district END AS dongcode,
          CASE WHEN k % 79 <> 0 THEN 'DONG_' || district END AS dongname,
          CASE WHEN s % 17 = 0 THEN '' ELSE 'Road ' || s END AS road,
          CASE WHEN s % 34 = 0 THEN '' ELSE 'Lot ' || s END AS lot,
          CASE WHEN k % 89 = 0 THEN NULL WHEN k % 97 = 0 THEN ' '
               ELSE 'B' || lpad(s::VARCHAR, greatest(5, length(s::VARCHAR))::INTEGER, '0') END AS bld,
          CASE WHEN ln = 7 THEN '' ELSE ' ' || (b % 4 + 1) || ' ' END AS flr,
          NULL::VARCHAR AS unit,
          CASE WHEN k % 101 = 0 THEN 'x' WHEN k % 103 = 0 THEN '0' ELSE '126.' || (s % 50 + 50) END AS lng_text,
          '37.' || lpad((s * 37 % 100)::VARCHAR, 2, '0') AS lat_text
        FROM line WHERE b % 5 <> q % 7""",
    "now": f"SELECT max((year(l_shipdate) - {BASE_YEAR}) * 4 + quarter(l_shipdate) - 1)::INTEGER AS latest FROM lineitem",
    "stores": f"""
        SELECT DISTINCT ON (qord, store_id) * FROM (
          SELECT qord, store_id, {_clean_name('shop', 'branch')} AS name_norm, coalesce(cat, '?') AS cat_code,
            coalesce(catname, '미분류') AS cat_name, sido AS sido_code, sidoname AS sido_name, sgg AS sigungu_code,
            sggname AS sigungu_name, dongcode AS dong_code, dongname AS dong_name,
            coalesce(nullif(road, ''), nullif(lot, ''), '') AS road_address, bld AS building_id,
            {_FLOOR} AS floor_label, bld || '#' || {_FLOOR} AS place_key,
            try_cast(lng_text AS DOUBLE) AS lng, try_cast(lat_text AS DOUBLE) AS lat
          FROM raw WHERE NOT {_UNUSABLE})
        ORDER BY qord, store_id, place_key, name_norm, cat_code, cat_name, road_address, sido_code NULLS LAST,
          sido_name NULLS LAST, sigungu_code NULLS LAST, sigungu_name NULLS LAST, dong_code NULLS LAST,
          dong_name NULLS LAST, building_id, lng, lat""",
    "opening": """
        SELECT store_id, place_key, qord,
               row_number() OVER (PARTITION BY store_id, place_key ORDER BY qord) - 1 AS island
        FROM stores o WHERE NOT EXISTS (SELECT 1 FROM stores p WHERE p.store_id = o.store_id
          AND p.place_key = o.place_key AND p.qord IN (o.qord - 1, o.qord - 2))""",
    "closing": """
        SELECT * FROM stores o WHERE NOT EXISTS (SELECT 1 FROM stores p WHERE p.store_id = o.store_id
          AND p.place_key = o.place_key AND p.qord IN (o.qord + 1, o.qord + 2))""",
    "spans": """
        SELECT o.store_id, o.place_key, o.island::INTEGER AS island, o.qord AS start_q, c.qord AS end_q,
               c.name_norm, c.cat_code, c.cat_name
        FROM opening o ASOF JOIN closing c
          ON o.store_id = c.store_id AND o.place_key = c.place_key AND o.qord <= c.qord""",
    "walked": """
        SELECT *, CASE WHEN name_norm = '' THEN store_id || '/' || island ELSE '' END AS own,
          row_number() OVER walk AS pos, lag(end_q) OVER walk AS before_end
        FROM spans
        WINDOW walk AS (PARTITION BY place_key, name_norm, CASE WHEN name_norm = '' THEN store_id || '/' || island ELSE '' END
                        ORDER BY start_q, end_q, cat_code, cat_name, store_id, island)""",
    "logical": """
        SELECT w.place_key, w.name_norm, min(w.start_q) AS start_q, max(w.end_q) AS end_q,
               max({'e': w.end_q, 's': w.start_q, 'c': w.cat_code, 'n': w.cat_name})['c'] AS cat_code,
               max({'e': w.end_q, 's': w.start_q, 'c': w.cat_code, 'n': w.cat_name})['n'] AS cat_name,
               count(*) AS merged_spans
        FROM walked w ASOF JOIN (SELECT place_key, name_norm, own, pos FROM walked
                                 WHERE before_end IS NULL OR start_q - before_end > 2) h
          ON w.place_key = h.place_key AND w.name_norm = h.name_norm AND w.own = h.own AND w.pos >= h.pos
        GROUP BY w.place_key, w.name_norm, w.own, h.pos""",
    "boundaries": """
        SELECT place_key, boundary_q, sum(e)::BIGINT AS n_ended, sum(b)::BIGINT AS n_started FROM (
          SELECT place_key, end_q AS boundary_q, 1 AS e, 0 AS b FROM logical, now WHERE end_q < latest
          UNION ALL SELECT place_key, start_q - 1, 0, 1 FROM logical WHERE start_q > 0)
        GROUP BY place_key, boundary_q""",
    "turnover": """
        SELECT place_key, sum(CASE WHEN n_ended < n_started THEN n_ended ELSE n_started END)::INTEGER AS turnover_count
        FROM boundaries WHERE n_ended * n_started > 0 GROUP BY place_key""",
    "profile": """
        SELECT place_key,
          max({'q': qord, 's': store_id, 'v': building_id})['v'] AS building_id,
          max({'q': qord, 's': store_id, 'v': floor_label})['v'] AS floor_label,
          max({'q': qord, 's': store_id, 'v': road_address})['v'] AS road_address,
          (max({'q': qord, 's': store_id, 'v': sido_code}) FILTER (sido_code IS NOT NULL))['v'] AS sido_code,
          (max({'q': qord, 's': store_id, 'v': sigungu_code}) FILTER (sigungu_code IS NOT NULL))['v'] AS sigungu_code,
          (max({'q': qord, 's': store_id, 'v': dong_code}) FILTER (dong_code IS NOT NULL))['v'] AS dong_code,
          max({'q': qord, 's': store_id, 'v': lat})['v'] AS lat,
          max({'q': qord, 's': store_id, 'v': lng})['v'] AS lng,
          min(qord) AS first_q, max(qord) AS last_q,
          count(*) FILTER (qord = latest) AS stores_current, count(*) FILTER (qord = latest - 1) AS stores_prev
        FROM stores, now GROUP BY place_key""",
    "tenure": """
        SELECT place_key, avg((end_q - start_q + 1) * 3.0::DOUBLE) AS avg_tenure_months
        FROM logical, now WHERE end_q < latest GROUP BY place_key""",
    "category": """
        SELECT place_key, m['c'] AS code, m['n'] AS name FROM (
          SELECT place_key, max({'s': start_q, 'e': end_q, 'm': name_norm, 'c': cat_code, 'n': cat_name}) AS m
          FROM logical, now WHERE end_q = latest GROUP BY place_key)""",
    "places": f"""
        SELECT place_key, building_id, floor_label, road_address, sido_code, sigungu_code, dong_code, lat, lng,
          coalesce(turnover_count, 0) AS turnover_count, {_tenth('avg_tenure_months')} AS avg_tenure_months,
          CASE floor_label WHEN '미상' THEN 'low' ELSE 'high' END AS confidence, stores_current,
          stores_current + stores_prev > 0 AS is_occupied,
          code AS current_category_code, name AS current_category_name,
          {_label('first_q')} AS first_quarter, {_label('last_q')} AS last_quarter
        FROM profile LEFT JOIN turnover USING (place_key) LEFT JOIN tenure USING (place_key)
        LEFT JOIN category USING (place_key)""",
    "history": f"""
        SELECT place_key,
          row_number() OVER (PARTITION BY place_key ORDER BY start_q, end_q, name_norm, cat_code, cat_name)::INTEGER AS seq,
          {_label('start_q')} AS start_quarter, CASE WHEN end_q <> latest THEN {_label('end_q')} END AS end_quarter,
          cat_code AS category_code, cat_name AS category_name, end_q - start_q + 1 AS tenure_quarters
        FROM logical, now""",
    "names": """
        SELECT lv.level AS region_level, lv.code AS region_code,
               (max({'q': qord, 'n': lv.name}) FILTER (lv.name IS NOT NULL))['n'] AS region_name
        FROM (SELECT qord, unnest([{'level': 'sido', 'code': sido_code, 'name': sido_name},
                                   {'level': 'sigungu', 'code': sigungu_code, 'name': sigungu_name},
                                   {'level': 'dong', 'code': dong_code, 'name': dong_name}]) AS lv FROM stores)
        GROUP BY lv.level, lv.code""",
    "regions": f"""
        SELECT lv.level AS region_level, lv.code AS region_code, coalesce(any_value(region_name), lv.code) AS region_name,
          round(avg(lat), 6) AS center_lat, round(avg(lng), 6) AS center_lng, count(*) AS place_count,
          sum(turnover_count)::BIGINT AS turnover_sum,
          floor(avg(turnover_count) * 100 + 0.5) / 100::DOUBLE AS turnover_avg,
          count(*) FILTER (turnover_count >= 3) AS hot_place_count,
          {_tenth('sum(round(avg_tenure_months * 10)) / count(avg_tenure_months) / 10')} AS avg_tenure_months
        FROM (SELECT *, unnest([{{'level': 'sido', 'code': sido_code}}, {{'level': 'sigungu', 'code': sigungu_code}},
                                {{'level': 'dong', 'code': dong_code}}]) AS lv FROM places) p
        LEFT JOIN names n ON n.region_level = lv.level AND n.region_code = lv.code
        GROUP BY lv.level, lv.code""",
    "viewports": f"""
        SELECT c_custkey AS viewport_id, (x - h) / 100.0::DOUBLE AS min_lng, (y - h) / 100.0::DOUBLE AS min_lat,
          (x + h) / 100.0::DOUBLE AS max_lng, (y + h) / 100.0::DOUBLE AS max_lat,
          (c_custkey % 3 * 5)::INTEGER AS min_turnover,
          {list(ROW_LIMITS)}[c_custkey % {len(ROW_LIMITS)} + 1] AS max_rows
        FROM (SELECT c_custkey, c_custkey * 7 % 50 + 12650 AS x, c_custkey * 53 % 100 + 3700 AS y,
                     {list(HALF_WIDTHS)}[c_custkey % {len(HALF_WIDTHS)} + 1] AS h FROM customer)""",
    "keys": """
        SELECT 'B' || lpad(s_suppkey::VARCHAR, greatest(5, length(s_suppkey::VARCHAR))::INTEGER, '0') || '#' || f AS place_key
        FROM supplier, (SELECT unnest(['1', '2', '3', '4', '5', '미상']) AS f)""",
    "shops": f"""
        SELECT qord, bld || '#' || {_FLOOR} AS place_key, {_clean_name('shop', 'branch')} AS name_norm,
          {_SHOWN} || ' · ' || coalesce(catname, '?') AS display, road AS road_address, sggname AS sigungu,
          dongname AS dong, {_FLOOR} AS floor_label
        FROM raw WHERE bld IS NOT NULL""",
    "side": """
        SELECT place_key, qord = 0 AS is_a, min(road_address) AS road_address, min(sigungu) AS sigungu, min(dong) AS dong,
          min(floor_label) AS floor_label, count(*) AS n,
          list_sort(list(DISTINCT name_norm) FILTER (name_norm <> '')) AS names,
          list_sort(list(DISTINCT display)) AS displays
        FROM shops, now WHERE qord IN (0, latest) GROUP BY place_key, qord = 0""",
    "compared": """
        SELECT coalesce(a.place_key, b.place_key) AS place_key, coalesce(a.road_address, b.road_address) AS road_address,
          coalesce(a.sigungu, b.sigungu) AS sigungu, coalesce(a.dong, b.dong) AS dong,
          coalesce(a.floor_label, b.floor_label) AS floor_label, a.n AS n_a, b.n AS n_b,
          a.displays AS shown_a, b.displays AS shown_b,
          len(a.names) + len(b.names) - len(list_distinct(list_concat(a.names, b.names))) AS survived,
          CASE WHEN a.n IS NULL THEN '신규 자리' WHEN b.n IS NULL THEN '자리 소멸(공실 후보)'
               WHEN a.names IS NULL OR b.names IS NULL THEN '판정 곤란(상호 결측)'
               WHEN NOT list_has_any(a.names, b.names) THEN '전원 교체'
               WHEN NOT list_has_all(b.names, a.names) THEN '일부 교체' ELSE '유지' END AS verdict
        FROM (SELECT * FROM side WHERE is_a) a FULL JOIN (SELECT * FROM side WHERE NOT is_a) b ON a.place_key = b.place_key""",
    "flat": _flat(1000),
    "seen": f"""
        SELECT DISTINCT qord, sidoname AS province, {_label('qord')} AS label,
          make_date({BASE_YEAR} + qord // 4, (qord % 4 + 1) * 3, 1)::VARCHAR AS day FROM raw""",
}

_BOX = "lng BETWEEN {0} AND {2} AND lat BETWEEN {1} AND {3}".format(*ONE_BOX)
_REGION_BOX = _BOX.replace("lng", "center_lng").replace("lat ", "center_lat ")
_EDGE = "printf('%.3f', {0})"
_MAP_LEVEL = """CASE WHEN max_lng - min_lng < 0.08 THEN 'places' WHEN max_lng - min_lng < 0.35 THEN 'dong'
                     WHEN max_lng - min_lng < 1.5 THEN 'sigungu' ELSE 'sido' END"""


def _short(label: str) -> str:
    return f"(substr({label}, 1, 4) || '.' || substr({label}, 6) || '분기')"


def _long(label: str) -> str:
    return f"(substr({label}, 1, 4) || '년 ' || substr({label}, 6) || '분기')"


_SYMBOL = "CASE substr(category_code, 1, 2) {} ELSE '{}' END".format(
    " ".join(f"WHEN '{code}' THEN '{symbol}'" for code, symbol in CATEGORY_SYMBOLS.items()), OTHER_CATEGORY_SYMBOL
)
_STAY = """CASE WHEN tenure_quarters < 4 THEN (tenure_quarters * 3) || '개월'
                WHEN tenure_quarters % 4 = 0 THEN (tenure_quarters // 4) || '년'
                ELSE (tenure_quarters // 4) || '년 ' || (tenure_quarters % 4 * 3) || '개월' END"""
_MEAN = "floor(avg_tenure_months + 0.5)::BIGINT"

_FIRST_LABEL = f"{BASE_YEAR}Q1"
_PLACE_NOT_NULL = (
    "place_key building_id floor_label road_address sido_code sigungu_code dong_code lat lng turnover_count confidence "
    "stores_current is_occupied first_quarter last_quarter"
).split()
_HISTORY_NOT_NULL = "place_key seq start_quarter category_code category_name".split()
_REGION_NOT_NULL = (
    "region_level region_code region_name center_lat center_lng place_count turnover_sum turnover_avg hot_place_count"
).split()


def _null_counts(name: str, table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", '{c} not null' AS rule, count(*) - count({c}) AS violations FROM {table}"
        for c in columns
    )


def _repeats(name: str, table: str, key: str) -> str:
    return f"SELECT '{name}', '{key} unique', count(*) FROM (SELECT {key} FROM {table} GROUP BY {key} HAVING count(*) > 1)"


def _missing(metric: str, test: str) -> str:
    return f"SELECT qord, '{metric}' AS metric, count(*) FILTER ({test}) AS rows, count(*) AS n FROM raw GROUP BY qord"


_BODIES = {
    "name_norm": f"""
        SELECT shop AS name, branch, {_clean_name('shop', 'branch')} AS name_norm, {_SHOWN} AS display, count(*) AS rows
        FROM raw GROUP BY ALL""",
    "normalized_snapshot": "SELECT * FROM stores",
    "drop_report": f"""
        SELECT qord, count(*) AS total, count(*) FILTER ({_UNUSABLE}) AS dropped, any_value(n) AS kept
        FROM raw JOIN (SELECT qord, count(*) AS n FROM stores GROUP BY qord) USING (qord) GROUP BY qord""",
    "drop_report_one_province": f"""
        SELECT qord, count(*) AS total, count(*) FILTER ({_UNUSABLE}) AS dropped,
               count(DISTINCT store_id) FILTER (NOT {_UNUSABLE}) AS kept
        FROM raw WHERE sidoname LIKE '%ASIA%' GROUP BY qord""",
    "period_labels": f"""
        SELECT qord, {_label('qord')} AS label, qord AS ordinal, {_MONTH} AS last_month, {_label('qord')} AS month_label,
          {_short(_label('qord'))} AS short_text, {_long(_label('qord'))} AS long_text, count(*) AS rows
        FROM raw GROUP BY qord""",
    "id_date_contamination": f"""
        SELECT qord, count(*) AS total, count(*) FILTER ({_LATE}) AS late_ids,
               {_tenth(f'count(*) FILTER ({_LATE}) * 100.0::DOUBLE / count(*)')} AS late_pct
        FROM raw GROUP BY qord""",
    "spans": "SELECT * FROM spans",
    "logical_stores": "SELECT * FROM logical",
    "boundary_counts": "SELECT * FROM boundaries",
    "place_turnover": "SELECT * FROM turnover",
    "merge_counts": """
        SELECT a.n AS spans, b.n AS logical_stores, a.n - b.n AS merged_away
        FROM (SELECT count(*) AS n FROM spans) a, (SELECT count(*) AS n FROM logical) b""",
    "place_profile": "SELECT * FROM profile",
    "place_tenure": "SELECT * FROM tenure",
    "current_category": "SELECT * FROM category",
    "places": "SELECT * FROM places",
    "place_points": f"""
        SELECT lng, lat, list_sum(list_transform(range({KEY_BITS}), lambda i: (((x >> i) & 1) << (2 * i)) + (((y >> i) & 1) << (2 * i + 1))))::BIGINT AS cell_key,
          places, turnover_sum
        FROM (SELECT lng, lat, floor(lng / {FINEST_CELL!r}::DOUBLE)::BIGINT + {1 << KEY_BITS - 1} AS x,
                floor(lat / {FINEST_CELL!r}::DOUBLE)::BIGINT + {1 << KEY_BITS - 1} AS y,
                count(*) AS places, sum(turnover_count)::BIGINT AS turnover_sum FROM places GROUP BY lng, lat)""",
    "place_history": "SELECT * FROM history",
    "top_turnover": """
        SELECT place_key, turnover_count, road_address, floor_label FROM places
        ORDER BY turnover_count DESC, place_key LIMIT 10""",
    "region_names": "SELECT * FROM names",
    "region_stats": "SELECT * FROM regions",
    "viewport_places_one": f"""
        SELECT * FROM places WHERE {_BOX} AND turnover_count >= 2 ORDER BY turnover_count DESC, place_key LIMIT 1000""",
    "viewport_places_batch": """
        SELECT viewport_id, rank::INTEGER AS rank, place_key, turnover_count FROM (
          SELECT viewport_id, place_key, turnover_count, max_rows,
                 row_number() OVER (PARTITION BY viewport_id ORDER BY turnover_count DESC, place_key) AS rank
          FROM viewports JOIN places ON lng BETWEEN min_lng AND max_lng AND lat BETWEEN min_lat AND max_lat
           AND turnover_count >= min_turnover)
        WHERE rank <= least(greatest(max_rows, 1), 1000)""",
    "viewport_regions_one": f"SELECT * FROM regions WHERE region_level = 'dong' AND {_REGION_BOX}",
    "viewport_regions": f"""
        SELECT viewport_id, region_level, region_code, region_name, place_count, turnover_avg
        FROM viewports JOIN regions ON region_level = {_MAP_LEVEL}
         AND center_lng BETWEEN min_lng AND max_lng AND center_lat BETWEEN min_lat AND max_lat""",
    "map_level": f"""
        SELECT viewport_id, {_MAP_LEVEL} AS map_level,
          {" || ',' || ".join(_EDGE.format(e) for e in ('min_lng', 'min_lat', 'max_lng', 'max_lat'))} AS box_key
        FROM viewports""",
    "place_detail": _details(1000),
    "place_detail_pages": _details(3),
    "place_detail_stored": _details(1000),
    "place_documents": _documents(1000),
    "place_documents_pages": _documents(3),
    "period_text": f"""
        SELECT place_key, seq, {_SYMBOL} AS symbol, {_STAY} AS tenure_text,
          {_short('start_quarter')} || ' ~ ' || CASE WHEN end_quarter IS NULL THEN '영업 중'
            ELSE {_short('end_quarter')} || ' (' || {_STAY} || ')' END AS period_text
        FROM history""",
    "address_line": f"""
        SELECT place_key, road_address || ' · ' || CASE floor_label WHEN '미상' THEN '층 미상' ELSE floor_label || '층' END
          || coalesce(' · 평균 ' || {_MEAN} || '개월', '') AS address_line
        FROM places""",
    "headline": f"""
        SELECT place_key, kind,
          CASE kind WHEN 'vacant' THEN '지금은 비어 있는 것으로 보이는 자리'
            WHEN 'shared' THEN '이 층 점포 ' || stores_current || '곳 · 교체 ' || turnover_count || '번'
            WHEN 'changed' THEN '이 자리, 주인이 ' || turnover_count || '번 바뀌었습니다'
            WHEN 'kept_since_first' THEN '한 가게가 3년 넘게 지키고 있는 자리'
            ELSE '한 가게가 지키고 있는 자리' END AS title,
          CASE kind WHEN 'vacant' THEN '마지막 영업 기록: ' || {_short('last_end')}
            WHEN 'shared' THEN '층 단위 정보라 점포별 구분은 정확하지 않을 수 있어요'
            WHEN 'changed' THEN '평균 ' || {_MEAN} || '개월마다 새 가게가 들어왔어요'
            ELSE {_long('first_quarter')} || '부터 계속 영업 중' END AS subtitle
        FROM (SELECT *, CASE WHEN NOT is_occupied THEN 'vacant' WHEN stores_current > 1 THEN 'shared'
                WHEN turnover_count > 0 THEN 'changed' WHEN first_quarter = '{_FIRST_LABEL}' THEN 'kept_since_first'
                ELSE 'kept' END AS kind
              FROM places LEFT JOIN (SELECT place_key, max(end_quarter) AS last_end FROM history GROUP BY place_key)
              USING (place_key))""",
    "dong_comparison": """
        SELECT place_key, kind, '이 동네 평균(' || printf('%.1f', dong_avg) || '번)' || CASE kind
            WHEN 'frequent' THEN '보다 눈에 띄게 잦은 자리예요' WHEN 'similar' THEN '과 비슷한 수준이에요'
            WHEN 'lasting' THEN '보다 오래 버티는 자리예요' END AS text
        FROM (SELECT place_key, r.turnover_avg AS dong_avg, CASE WHEN r.turnover_avg > 0 THEN
                CASE WHEN turnover_count / r.turnover_avg >= 2 THEN 'frequent'
                     WHEN turnover_count / r.turnover_avg <= 0.5 THEN 'lasting' ELSE 'similar' END END AS kind
              FROM places LEFT JOIN regions r ON r.region_level = 'dong' AND r.region_code = dong_code)""",
    "category_group": f"""
        SELECT {_SYMBOL} AS symbol, count(*) AS stays, sum(tenure_quarters)::BIGINT AS tenure_quarters
        FROM history GROUP BY 1""",
    "turnover_buckets": """
        SELECT CASE WHEN turnover_count > 5 THEN 5 ELSE turnover_count END AS bucket, count(*) AS places
        FROM places GROUP BY 1""",
    "snapshot_diff": "SELECT * FROM flat",
    "snapshot_diff_pages": _flat(3),
    "verdict_distribution": f"""
        SELECT verdict, places, {_tenth('places * 100.0::DOUBLE / n')} AS pct
        FROM (SELECT verdict, count(*) AS places FROM compared GROUP BY verdict
              UNION ALL SELECT '(합계)', count(*) FROM compared), (SELECT count(*) AS n FROM compared)""",
    "verdicts_by_count": """
        SELECT verdict, places, row_number() OVER (ORDER BY places DESC, verdict)::INTEGER AS position
        FROM (SELECT verdict, count(*) AS places FROM compared GROUP BY verdict)""",
    "missing_profile": f"""
        SELECT qord, metric, rows, {_tenth('rows * 100.0::DOUBLE / n')} AS pct FROM (
          {' UNION ALL '.join([
              _missing('total', 'TRUE'), _missing('no_building', "coalesce(trim(bld), '') = ''"),
              _missing('no_floor', "coalesce(trim(flr), '') = ''"), _missing('no_unit', "coalesce(trim(unit), '') = ''"),
              _missing('late_id', _LATE), _missing('bad_coordinates', _BAD_POINT)])})""",
    "place_size_quantiles": """
        SELECT qord, median(n) AS median, quantile_cont(n, 0.95) AS p95, max(n) AS largest
        FROM (SELECT qord, place_key, count(*) AS n FROM shops GROUP BY qord, place_key) GROUP BY qord""",
    "place_size_sketches": f"""
        SELECT ({BASE_YEAR} + qord // 4)::INTEGER AS year, count(*) AS places, TRUE AS p50_close, TRUE AS p95_close
        FROM (SELECT qord, place_key FROM shops GROUP BY qord, place_key) GROUP BY 1""",
    "place_search": f"""
        SELECT term, rank::INTEGER AS rank, matches, place_key, road_address, floor_label, verdict FROM (
          SELECT *, row_number() OVER (PARTITION BY term ORDER BY road_address NULLS LAST, floor_label NULLS LAST, place_key) AS rank,
                 count(*) OVER (PARTITION BY term) AS matches
          FROM compared, (SELECT DISTINCT trim(t) AS term FROM (SELECT unnest([{_LIST(f"'{t}'" for t in SEARCH_TERMS)}]) AS t))
          WHERE length(term) >= 2 AND (contains(road_address, term)
            OR contains(list_aggregate(list_concat(coalesce(shown_a, []), coalesce(shown_b, [])), 'string_agg', chr(10)), term)))
        WHERE rank <= 300""",
    "place_browse": """
        SELECT place_key, road_address, floor_label, verdict FROM compared
        ORDER BY road_address NULLS LAST, floor_label NULLS LAST, place_key LIMIT 200""",
    "diff_csv": "SELECT verdict, count(*) AS places, sum(coalesce(n_a, 0))::BIGINT AS n_a FROM compared GROUP BY verdict",
    "district_export": """
        SELECT sigungu, place_key, chunk, road_address, floor_label, n_a, n_b, display_a, display_b, verdict
        FROM flat WHERE sigungu IS NOT NULL""",
    "quality_checks": f"""
        WITH p AS (SELECT count(*) AS n, count(*) FILTER (confidence = 'low') AS low,
                     count(*) FILTER (floor_label = '미상') AS unknown, min(avg_tenure_months) AS lo,
                     max(avg_tenure_months) AS hi, count(*) FILTER (turnover_count = 0) AS zero FROM places),
             c AS (SELECT turnover_count AS t, count(*) AS c, row_number() OVER (ORDER BY turnover_count) AS pos FROM places GROUP BY turnover_count),
             h AS (SELECT max(c) AS most, string_agg(t || ':' || c, ', ' ORDER BY t) FILTER (pos <= 6) AS head FROM c),
             o AS (SELECT count(*) AS n FROM history WHERE place_key NOT IN (SELECT place_key FROM places)),
             v AS (SELECT count(*) AS n FROM history WHERE start_quarter > end_quarter),
             d AS (SELECT sum(place_count)::BIGINT AS n FROM regions WHERE region_level = 'dong'),
             g AS (SELECT count(*) AS n, count(*) FILTER (place_key IN (SELECT place_key FROM places)) AS hit FROM keys)
        SELECT c['check'] AS "check", c['ok'] AS ok, c['detail'] AS detail FROM (SELECT unnest([
          {{'check': 'place_count', 'ok': p.n BETWEEN {PLACE_COUNT_RANGE[0]} AND {PLACE_COUNT_RANGE[1]}, 'detail': p.n::VARCHAR}},
          {{'check': 'zero_turnover_is_mode', 'ok': zero = most, 'detail': head}},
          {{'check': 'no_orphan_history', 'ok': o.n = 0, 'detail': o.n::VARCHAR}},
          {{'check': 'no_inverted_interval', 'ok': v.n = 0, 'detail': v.n::VARCHAR}},
          {{'check': 'low_confidence_is_unknown_floor', 'ok': low = unknown, 'detail': low || '/' || unknown}},
          {{'check': 'dong_places_add_up', 'ok': d.n = p.n, 'detail': d.n || '/' || p.n}},
          {{'check': 'tenure_range', 'ok': lo >= {TENURE_RANGE[0]} AND hi <= {TENURE_RANGE[1]},
            'detail': printf('%.1f', lo) || '~' || printf('%.1f', hi)}},
          {{'check': 'gate_places_found', 'ok': hit = g.n, 'detail': hit || '/' || g.n}}]) AS c
        FROM p, h, o, v, d, g)""",
    "orphan_history": """
        SELECT place_key, count(*) AS history_rows FROM history
        WHERE place_key NOT IN (SELECT place_key FROM places WHERE stores_current > 0) GROUP BY place_key""",
    "history_cascade": """
        SELECT place_key, count(*) AS stays, max(seq) AS last_seq FROM history
        WHERE place_key IN (SELECT place_key FROM places WHERE stores_current > 0) GROUP BY place_key""",
    "gate_lookup": """
        SELECT count(*) AS listed, count(p.place_key) AS found, count(*) = count(p.place_key) AS ok
        FROM keys k LEFT JOIN places p USING (place_key)""",
    "turnover_histogram": """
        SELECT turnover_count, places, places = max(places) OVER () AS is_mode
        FROM (SELECT turnover_count, count(*) AS places FROM places GROUP BY turnover_count)""",
    "constraint_violations": " UNION ALL ".join(
        [
            _null_counts("places", "places", _PLACE_NOT_NULL),
            "SELECT 'places', 'confidence allowed', count(*) FROM places WHERE confidence NOT IN ('high', 'low')",
            _repeats("places", "places", "place_key"),
            _null_counts("place_history", "history", _HISTORY_NOT_NULL),
            _repeats("place_history", "history", "place_key,seq"),
            "SELECT 'place_history', 'place_key references places', count(*) FROM history "
            "WHERE place_key NOT IN (SELECT place_key FROM places)",
            _null_counts("region_stats", "regions", _REGION_NOT_NULL),
            "SELECT 'region_stats', 'region_level allowed', count(*) FROM regions "
            "WHERE region_level NOT IN ('sido', 'sigungu', 'dong')",
            _repeats("region_stats", "regions", "region_level,region_code"),
        ]
    ),
    "appended_spans": "SELECT * FROM spans",
    "publish_roundtrip": "SELECT * FROM history",
    "meta_upsert": """
        SELECT province || '/latest_quarter' AS key, max(label) AS value, max(day) AS updated_at FROM seen GROUP BY province""",
    "meta_record": """
        SELECT max(label) AS latest_quarter, '전국' AS coverage, max(label) || '+' || max(day) AS data_version FROM seen""",
    "csv_union_by_name": "SELECT * FROM stores",
    "csv_one_province": "SELECT * FROM stores WHERE sido_name LIKE '%ASIA%'",
    "size_report": """
        SELECT 'places' AS "table", TRUE AS has_files, TRUE AS has_bytes, count(*) AS rows FROM places
        UNION ALL SELECT 'place_history', TRUE, TRUE, count(*) FROM history
        UNION ALL SELECT 'region_stats', TRUE, TRUE, count(*) FROM regions""",
    "csv_quarantine": f"""
        SELECT qord, count(*) + any_value(m) AS total, any_value(m) AS malformed,
               count(*) FILTER ({_UNUSABLE}) AS dropped, any_value(n) AS kept
        FROM raw JOIN (SELECT qord, count(*) AS n FROM stores GROUP BY qord) USING (qord)
        JOIN (SELECT qord, 2 * count(DISTINCT sido) AS m FROM raw GROUP BY qord) USING (qord) GROUP BY qord""",
    "label_check": """
        SELECT path, label, content_label, label = content_label AS ok FROM (
          SELECT DISTINCT '/raw/' || o || '/상가(상권)정보_' || m || '.csv' AS path, o AS label, c AS content_label FROM (
            SELECT (year(o_orderdate) + 20) || 'Q' || quarter(o_orderdate) AS o,
                   (year(l_shipdate) + 20) || strftime(l_shipdate, '%m') AS m,
                   (year(l_shipdate) + 20) || 'Q' || quarter(l_shipdate) AS c
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey))""",
}


def _needed(sql: str) -> list[str]:
    """Names of the common tables a body depends on, in order of definition."""
    wanted: set[str] = set()
    pending = [sql]
    while pending:
        words = set(pending.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name, body in _CTES.items():
            if name in words and name not in wanted:
                wanted.add(name)
                pending.append(body)
    return [name for name in _CTES if name in wanted]


def statements() -> dict[str, str]:
    found = {}
    for name, body in _BODIES.items():
        parts = [f"{cte} AS MATERIALIZED ({_CTES[cte]})" for cte in _needed(body)]
        inner = body.strip()
        prefix = f"WITH {', '.join(parts)} " if parts else ""
        found[name] = f"{prefix}SELECT * FROM ({inner})" if inner.startswith("WITH") else prefix + inner
    return found
