"""SQL of the corpus tables, as named common table expressions that queries' SQL is made of."""

from __future__ import annotations

PARTS = {
    "pages": "SELECT doc_id AS page, lang AS dataset, list_sort(list_transform(list_distinct(list_filter(string_split(text, ''), lambda c: c <> '')), lambda c: unicode(c))) AS cps FROM documents",
    "page_cp": "SELECT page, dataset, unnest(cps) AS cp FROM pages",
    "font": "SELECT cp, row_number() OVER (ORDER BY cp) AS gid FROM (SELECT DISTINCT cp FROM page_cp)",
    "seg": "SELECT ((row_number() OVER (ORDER BY cp) - 1) // 8)::INT AS segment_id, cp, gid FROM font WHERE cp > 32",
    "ids": "SELECT DISTINCT segment_id FROM seg",
    "top": "SELECT max(segment_id) AS top FROM ids",
    "cond": """
        SELECT segment_id AS condition_id, [[segment_id]] AS groups FROM ids
        UNION ALL SELECT 1000 + segment_id, [[segment_id, segment_id + 1]] FROM ids, top WHERE segment_id + 1 <= top AND segment_id % 2 = 0
        UNION ALL SELECT 2000 + segment_id, [[segment_id], [segment_id + 2]] FROM ids, top WHERE segment_id + 2 <= top AND segment_id % 3 = 0""",
    "grp": "SELECT condition_id, unnest(range(len(groups))) AS group_no, unnest(groups) AS g FROM cond",
    "lit": "SELECT condition_id, group_no, unnest(g) AS segment_id FROM grp",
    "glyphs": "SELECT segment_id AS condition_id, gid FROM seg UNION ALL SELECT condition_id, unnest([condition_id * 2, condition_id * 2 + 1]) FROM cond WHERE condition_id >= 1000",
    "sizes": "SELECT condition_id, (29 + floor((5 + count(*) * CASE WHEN count(*) > 255 THEN 3 ELSE 2 END + 4 + 4 * (count(*) + 1) + sum(40 + (gid * 37) % 200)) * 0.5::DOUBLE))::BIGINT AS size FROM glyphs GROUP BY condition_id",
    "single": "SELECT dataset, cp AS cp1, cp AS cp2, count(*) AS n FROM page_cp GROUP BY dataset, cp",
    "pairs": "SELECT a.dataset, a.cp AS cp1, b.cp AS cp2, count(*) AS n FROM page_cp a JOIN page_cp b ON a.page = b.page AND a.cp < b.cp GROUP BY 1, 2, 3",
    "counts": "SELECT * FROM single UNION ALL SELECT * FROM pairs",
    "prob": "SELECT dataset, cp1, cp2, n::DOUBLE / max(n) OVER (PARTITION BY dataset) AS p FROM counts",
    "uni": "SELECT dataset, cp1 AS cp, p FROM prob WHERE cp1 = cp2",
    "best": "SELECT dataset, 1.0::DOUBLE / max(n) AS unknown FROM counts GROUP BY dataset",
    "datasets": "SELECT DISTINCT dataset FROM page_cp",
    "seg_cp": "SELECT d.dataset, s.segment_id, s.cp, coalesce(u.p, b.unknown) AS p FROM seg s CROSS JOIN datasets d JOIN best b USING (dataset) LEFT JOIN uni u ON u.dataset = d.dataset AND u.cp = s.cp",
    "seg_uni": "SELECT dataset, segment_id, 1 - product(1 - p) AS p FROM seg_cp GROUP BY 1, 2",
    "seg_pair": """
        SELECT x.dataset, x.segment_id, x.cp AS a, y.cp AS b, x.p AS pa, y.p AS pb, coalesce(q.p, x.p * y.p) AS pab
        FROM seg_cp x JOIN seg_cp y ON x.dataset = y.dataset AND x.segment_id = y.segment_id AND x.cp < y.cp
        LEFT JOIN prob q ON q.dataset = x.dataset AND q.cp1 = x.cp AND q.cp2 = y.cp""",
    "seg_sum": "SELECT dataset, segment_id, sum(p) AS s1, max(p) AS m1 FROM seg_cp GROUP BY 1, 2",
    "seg_sum2": "SELECT dataset, segment_id, sum(pab) AS s2, max(pa + pb - pab) AS m2 FROM seg_pair GROUP BY 1, 2",
    "seg_star": "SELECT dataset, segment_id, max(t) AS star FROM (SELECT dataset, segment_id, j, sum(pab) AS t FROM (SELECT dataset, segment_id, a AS j, pab FROM seg_pair UNION ALL SELECT dataset, segment_id, b, pab FROM seg_pair) GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "seg_bound": """
        SELECT dataset, segment_id,
            CASE WHEN m1 >= 1 OR coalesce(m2, 0) >= 1 THEN 1.0::DOUBLE ELSE greatest(s1 - coalesce(s2, 0), coalesce(m2, 0), m1) END AS p_min,
            CASE WHEN m1 >= 1 OR coalesce(m2, 0) >= 1 THEN 1.0::DOUBLE ELSE greatest(least(s1 - coalesce(star, 0), 1.0::DOUBLE), s1 - coalesce(s2, 0), coalesce(m2, 0), m1) END AS p_max
        FROM seg_sum LEFT JOIN seg_sum2 USING (dataset, segment_id) LEFT JOIN seg_star USING (dataset, segment_id)""",
    "page_seg": "SELECT DISTINCT page, dataset, segment_id FROM page_cp JOIN seg USING (cp)",
    "hit": """
        SELECT page, dataset, condition_id FROM page_seg JOIN lit USING (segment_id)
        GROUP BY page, dataset, condition_id HAVING count(DISTINCT group_no) = (SELECT len(c.groups) FROM cond c WHERE c.condition_id = lit.condition_id)""",
    "n_groups": "SELECT condition_id, len(groups) AS n FROM cond",
    "hits": "SELECT page, dataset, condition_id FROM page_seg JOIN lit USING (segment_id) JOIN n_groups USING (condition_id) GROUP BY page, dataset, condition_id, n HAVING count(DISTINCT group_no) = n",
}
NEEDS = {
    "page_cp": ["pages"], "font": ["page_cp"], "seg": ["font"], "ids": ["seg"], "top": ["ids"], "cond": ["ids", "top"], "grp": ["cond"], "lit": ["grp"],
    "glyphs": ["seg", "cond"], "sizes": ["glyphs"], "single": ["page_cp"], "pairs": ["page_cp"], "counts": ["single", "pairs"], "prob": ["counts"], "uni": ["prob"],
    "best": ["counts"], "datasets": ["page_cp"], "seg_cp": ["seg", "datasets", "best", "uni"], "seg_uni": ["seg_cp"], "seg_pair": ["seg_cp", "prob"], "seg_sum": ["seg_cp"],
    "seg_sum2": ["seg_pair"], "seg_star": ["seg_pair"], "seg_bound": ["seg_sum", "seg_sum2", "seg_star"], "page_seg": ["page_cp", "seg"], "n_groups": ["cond"],
    "hits": ["page_seg", "lit", "n_groups"],
}
PARTS.pop("hit")


def query(final: str, *names: str, **more: str) -> str:
    """WITH the named parts and what they need, then further ones in the order given, then the final SELECT."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    parts = [f"{n} AS ({PARTS[n]})" for n in order] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final
