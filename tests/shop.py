"""A small database of allotment gardens, queries on it, and the tables and columns they use."""

TABLES = {
    "members": ("id bigint, name string, town string", [(1, "Ines", "Graz"), (2, "Otto", "Linz"), (3, "Pia", "Graz"), (5, "Ruth", "Wels")]),
    "kinds": ("id bigint, label string", [(1, "root"), (2, "leaf"), (3, "fruit"), (4, "herb")]),
    "crops": ("id bigint, kind_id bigint, label string", [(21, 1, "carrot"), (22, 1, "beet"), (23, 2, "kale"), (24, 3, "tomato"), (25, 4, "dill")]),
    "plots": (
        "id bigint, member_id bigint, leased string, rent double",
        [(11, 1, "2019-04-01", 80.0), (12, 1, "2021-03-15", 45.5), (13, 2, "2020-02-01", 120.0), (14, 3, "2022-05-05", 60.25)],
    ),
    "beds": (
        "plot_id bigint, crop_id bigint, plants bigint, seed_cost double",
        [(11, 21, 40, 0.05), (11, 24, 6, 1.5), (12, 23, 12, 0.25), (13, 22, 30, 0.1), (13, 24, 3, 1.5), (14, 25, 8, 0.2)],
    ),
}

QUERIES = {
    "window_union": """
        WITH spent AS (SELECT b.plot_id, SUM(b.plants * b.seed_cost) AS seeds FROM beds b GROUP BY b.plot_id),
        ranked AS (SELECT p.member_id, s.seeds, RANK() OVER (PARTITION BY p.member_id ORDER BY p.leased DESC) AS newest
            FROM plots p JOIN spent s ON s.plot_id = p.id)
        SELECT m.name, r.seeds AS amount FROM ranked r JOIN members m ON m.id = r.member_id WHERE r.newest = 1
        UNION ALL SELECT 'all seeds', SUM(seeds) FROM spent ORDER BY amount""",
    "exists": """
        SELECT k.label FROM kinds k
        WHERE NOT EXISTS (SELECT 1 FROM crops c JOIN beds b ON b.crop_id = c.id WHERE c.kind_id = k.id AND b.plants > 10) ORDER BY k.label""",
    "topk": """
        SELECT DISTINCT c.label FROM crops c RIGHT JOIN beds "bed" ON "bed".crop_id = c.id
        WHERE c.label IS NOT NULL AND ("bed".seed_cost < 1.0 OR c.label LIKE '%e%') ORDER BY c.label DESC LIMIT 3""",
    "having": """
        SELECT m.town, AVG(p.rent) AS mean_rent FROM members m JOIN plots p ON m.id = p.member_id
        GROUP BY m.town HAVING SUM(p.rent) > 100 ORDER BY mean_rent""",
    "scalar": """
        SELECT m.name, (SELECT MAX(rent) FROM plots) AS dearest
        FROM members m CROSS JOIN (SELECT MIN(label) AS first_kind FROM kinds) t WHERE t.first_kind <> m.name ORDER BY m.name DESC""",
    "length": "SELECT label, kind_id FROM crops ORDER BY LENGTH(label), id LIMIT 2",
}

LINEAGE = {
    "window_union": {"members": {"name", "id"}, "plots": {"id", "member_id", "leased"}, "beds": {"plot_id", "plants", "seed_cost"}},
    "exists": {"kinds": {"id", "label"}, "crops": {"id", "kind_id"}, "beds": {"crop_id", "plants"}},
    "topk": {"crops": {"id", "label"}, "beds": {"crop_id", "seed_cost"}},
    "having": {"members": {"town", "id"}, "plots": {"rent", "member_id"}},
    "scalar": {"members": {"name"}, "plots": {"rent"}, "kinds": {"label"}},
    "length": {"crops": {"label", "kind_id", "id"}},
}

ROWS = {
    "window_union": [("Pia", 1.6), ("Ines", 3.0), ("Otto", 7.5), ("all seeds", 23.1)],
    "exists": [("fruit",), ("herb",)],
    "topk": [("kale",), ("dill",), ("carrot",)],
    "having": [("Graz", 61.92), ("Linz", 120.0)],
    "scalar": [("Ruth", 120.0), ("Pia", 120.0), ("Otto", 120.0), ("Ines", 120.0)],
    "length": [("beet", 1), ("kale", 2)],
}


def write(spark, folder):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)
