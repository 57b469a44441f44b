"""Standing views that present the test tables as a product catalog.

The SQL is shared: Spark reads it through `view`, the reference SQL through `with_views`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

VIEWS: dict[str, tuple[list[str], str]] = {}


def _add(name: str, sources: list[str], sql: str) -> None:
    VIEWS[name] = (sources, sql)


_add("v_products", ["part"], """
SELECT p_partkey AS product_id,
       p_name AS product_name,
       concat(p_name, '|', p_type) AS product_class,
       CASE WHEN p_partkey % 17 = 0 THEN NULL
            WHEN p_partkey % 5 = 0 THEN concat('Furniture / ', p_type)
            WHEN p_partkey % 29 = 0 THEN concat('Sale / ', p_type)
            WHEN p_partkey % 31 = 0 THEN 'Browse By Brand / Other'
            WHEN p_partkey % 3 = 0 THEN concat('Furniture / ', p_type, ' / ', p_brand, ' / Red ', p_name)
            ELSE concat('Furniture / ', p_type, ' / ', p_brand) END AS category_hierarchy,
       CASE p_partkey % 4
            WHEN 0 THEN concat('A solid oak ', p_name, '. Some assembly required.')
            WHEN 1 THEN concat('Tufted velvet ', p_name, ' for the living room.')
            WHEN 2 THEN concat('Industrial steel ', p_name, '. Arrives fully assembled.')
            ELSE NULL END AS product_description,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            WHEN p_partkey % 11 = 0 THEN ' '
            ELSE concat(
              'Color:', CASE p_partkey % 6 WHEN 0 THEN 'Beige' WHEN 1 THEN 'Dark Gray' WHEN 2 THEN 'Navy' WHEN 3 THEN 'Light Gray Oak' WHEN 4 THEN 'Espresso' ELSE 'Red (matte)' END,
              ' | Material:', CASE p_partkey % 5 WHEN 0 THEN 'Solid Wood' WHEN 1 THEN 'Steel' WHEN 2 THEN 'Velvet' WHEN 3 THEN 'Faux Leather' ELSE 'Polyester' END,
              ' | Style:', CASE p_partkey % 3 WHEN 0 THEN 'Modern & Contemporary' WHEN 1 THEN 'Farmhouse / Country' ELSE 'Rustic' END,
              ' | Assembly Required:', CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Partial' ELSE '' END,
              ' | Room Type:', CASE p_partkey % 3 WHEN 0 THEN 'Bedroom, Living Room' WHEN 1 THEN 'Office' ELSE 'Patio; Deck' END,
              CASE WHEN p_partkey % 7 = 0 THEN ' | Color:Blue | Finish:Walnut' ELSE '' END,
              CASE p_partkey % 8 WHEN 1 THEN ' | Shape:Round | LevelOfAssembly:Full Assembly Needed' WHEN 5 THEN ' | TopShape: L-Shape | legmaterial: Brass : antique ' ELSE '' END) END AS product_features
FROM part""")

# One search query per supplier: the name of the part with the same key.
_add("v_queries", ["part", "supplier"], """
SELECT s_suppkey AS query_id, p_name AS query, p_type AS query_class
FROM supplier JOIN part ON p_partkey = s_suppkey""")

# Judgements: every (supplier, part) pair that was ever shipped together, equi-joined to both texts.
_add("v_labels", ["lineitem", "part", "supplier"], """
SELECT d.query_id, d.product_id,
       CASE WHEN q.p_name = p.p_name THEN 'Exact'
            WHEN split_part(q.p_name, ' ', 1) = split_part(p.p_name, ' ', 1)
              OR split_part(q.p_name, ' ', 2) = split_part(p.p_name, ' ', 2) THEN 'Partial'
            ELSE 'Irrelevant' END AS label
FROM (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS product_id FROM lineitem) d
JOIN part q ON q.p_partkey = d.query_id
JOIN part p ON p.p_partkey = d.product_id""")

# Search results to judge: all parts that one supplier shipped, in a fixed shuffle.
_add("v_results", ["lineitem"], """
SELECT query_id, product_id, rnk
FROM (SELECT query_id, product_id,
             row_number() OVER (PARTITION BY query_id ORDER BY md5(concat(CAST(query_id AS STRING), ':', CAST(product_id AS STRING)))) AS rnk
      FROM (SELECT DISTINCT l_suppkey AS query_id, l_partkey + CAST(l_linenumber = 1 AS INT) AS product_id FROM lineitem) d) t""")

# Product names that carry their colour in every layout the colour reader knows.
_add("v_named", ["part"], """
SELECT p_partkey AS product_id, concat(p_name, '|', p_type) AS product_class,
       CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' in Navy') WHEN 1 THEN concat(p_name, ' in Dark Gray ')
            WHEN 2 THEN concat('Dark Brown / Light Cream ', p_name) WHEN 3 THEN concat('Walnut/Brass ', p_name, ' w/o top')
            WHEN 4 THEN concat('Arm Chair ', p_name, ' in Unknowncolor') WHEN 5 THEN concat('Velvet sofa, ', p_name)
            WHEN 6 THEN upper(p_name) ELSE p_name END AS product_name,
       CASE p_partkey % 3 WHEN 0 THEN 'round table' WHEN 1 THEN 'seat in 72"" width, by Acme Bar XY900' ELSE 'tall oak thing 30 inch' END AS extra
FROM part""")

_add("v_calls", ["events"], """
SELECT event_id, ts,
       CASE user_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4-turbo' ELSE 'rule-based' END AS model,
       CAST(100 + event_id % 900 AS INT) AS input_tokens,
       CAST(20 + event_id % 200 AS INT) AS output_tokens,
       value AS latency_ms,
       event_type <> 'error' AS success,
       user_id
FROM events""")

_add("v_pairs", ["part"], """
SELECT p_partkey AS product_id, concat(p_name, '|', p_type) AS product_class,
       CASE WHEN p_partkey % 3 = 0 THEN 'rule-based' WHEN p_partkey % 3 = 1 THEN 'bert' ELSE 'llava' END AS model,
       p_partkey % 4 = 0 AS has_image,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'modern' ELSE 'rustic' END AS gt_style,
       CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'Contemporary' WHEN p_partkey % 2 = 0 THEN 'Modern' ELSE 'rustic ' END AS pred_style,
       CASE WHEN p_partkey % 3 = 0 THEN 'wood' ELSE 'metal' END AS gt_primary_material,
       CASE WHEN p_partkey % 4 = 0 THEN 'metal' ELSE 'wood' END AS pred_primary_material,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE split_part(p_name, ' ', 1) END AS gt_color_family,
       CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 8 = 0 THEN 'blue' ELSE split_part(p_name, ' ', 1) END AS pred_color_family,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'living room|bedroom' ELSE 'office' END AS gt_room_type,
       CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'Living Room|office' ELSE 'office' END AS pred_room_type,
       split_part(p_name, ' ', 2) AS gt_product_type,
       CASE WHEN p_partkey % 13 = 0 THEN 'sofa' ELSE split_part(p_name, ' ', 2) END AS pred_product_type
FROM part""")

# Head outputs in long form: one row per product and field.
_add("v_heads", ["part"], """
SELECT p_partkey AS product_id, f.i, f.field,
       CASE WHEN (p_partkey * 31 + f.i * 17) % 23 = 0 THEN '<UNK>' ELSE concat(f.field, '_', CAST(p_partkey % 5 AS STRING)) END AS val,
       ((p_partkey * 37 + f.i * 11) % 100) / CAST(100 AS DOUBLE) AS confidence
FROM part CROSS JOIN (VALUES (1, 'level_1'), (2, 'level_2'), (3, 'level_3'), (4, 'primary_color'), (5, 'style'), (6, 'assembly')) AS f(i, field)""")

# Raw answers of an attribute model in every layout the parsers must read.
_add("v_answers", ["part"], """
SELECT p_partkey AS product_id,
       CASE p_partkey % 10
         WHEN 0 THEN concat('{"style": "modern", "color_family": "', split_part(p_name, ' ', 1), '"}')
         WHEN 1 THEN concat('Sure, here it is: {"style": "Rustic", "product_type": "', p_name, '", "assembly_required": true} done')
         WHEN 2 THEN concat('style: farmhouse; color_family: ', split_part(p_name, ' ', 1), '; style: modern')
         WHEN 3 THEN concat('Product: ', p_name, chr(10), 'Primary Material: oak wood', chr(10), 'room type: living room, office; assembly_required: No')
         WHEN 4 THEN concat('The style = coastal and more', chr(10), 'color_family = ', split_part(p_name, ' ', 2), '; rest')
         WHEN 5 THEN '   '
         WHEN 6 THEN concat('style: modern', chr(10), chr(10), 'color_family: red')
         WHEN 7 THEN concat('color_family: blue/white/yellow/pink/red/green/black; product_type: ', p_name)
         WHEN 8 THEN 'no attributes at all in this answer'
         ELSE concat('style: none; primary_material: N/A; color_family: gray style: modern; secondary_material: ', repeat(concat(p_name, ' '), 15)) END AS answer,
       CASE p_partkey % 5
         WHEN 0 THEN concat('```json', chr(10), '{"style": "modern", "product_type": "', p_name, '"}', chr(10), '```')
         WHEN 1 THEN concat('{"color_family": "', split_part(p_name, ' ', 1), '", "room_type": null}')
         WHEN 2 THEN concat('Answer: {"style": "rustic", "color_family": "red"} thanks')
         WHEN 3 THEN '```{"style": "glam"}```'
         ELSE 'not json' END AS fenced
FROM part""")

# Products whose text decides every label; each eleventh is held out, and a fifth of these has no text.
_add("v_decided", ["part"], """
SELECT product_id, held_out, CASE WHEN NOT blank THEN concat_ws(' ', p_name, CASE s WHEN 0 THEN 'sleek minimal' WHEN 1 THEN 'reclaimed barn' ELSE 'mirrored gilded' END,
         CASE m WHEN 0 THEN 'oak' WHEN 1 THEN 'steel' WHEN 2 THEN 'velvet' ELSE 'tempered' END,
         CASE l WHEN 0 THEN 'with cushioned seat' WHEN 1 THEN 'hanging on a wall' ELSE 'with bulb and shade' END) END AS text_input,
       blank, CASE s WHEN 0 THEN 'modern' WHEN 1 THEN 'rustic' ELSE 'glam' END AS style,
       CASE WHEN NOT held_out AND product_id % 7 = 0 THEN NULL ELSE CASE m WHEN 0 THEN 'wood' WHEN 1 THEN 'metal' WHEN 2 THEN 'fabric' ELSE 'glass' END END AS primary_material,
       CASE l WHEN 0 THEN 'Furniture' WHEN 1 THEN 'Decor' ELSE 'Lighting' END AS level_1,
       concat(CASE l WHEN 0 THEN 'Seating' WHEN 1 THEN 'Wall Art' ELSE 'Lamps' END, CASE m WHEN 0 THEN ' of Wood' ELSE '' END) AS level_2,
       concat(CASE l WHEN 0 THEN 'Chair' WHEN 1 THEN 'Frame' ELSE 'Lamp' END, CASE s WHEN 1 THEN ' Classic' ELSE '' END) AS class_type
FROM (SELECT p_partkey AS product_id, p_name, p_partkey % 3 AS s, p_partkey % 4 AS m, CAST(floor(p_partkey / 7) AS BIGINT) % 3 AS l, p_partkey % 11 = 0 AS held_out,
        p_partkey % 11 = 0 AND CAST(floor(p_partkey / 11) AS BIGINT) % 5 = 0 AS blank FROM part) d""")

# Image candidates per product: every page is a candidate of two products, dealt over all of them.
_add("v_candidates", ["part", "pages"], """
SELECT p_partkey AS product_id, c.page_id AS position, p_name AS product_name,
       concat(c.url, CASE c.page_id % 4 WHEN 0 THEN '/large.jpg' WHEN 1 THEN '/thumb.png' WHEN 2 THEN '.webp' ELSE '' END) AS image,
       CASE WHEN (p_partkey + c.page_id) % 6 = 0 THEN 'https://www.Pinterest.com/x' ELSE c.url END AS url,
       CASE (p_partkey + c.page_id) % 3 WHEN 0 THEN concat('Buy ', p_name) WHEN 1 THEN split_part(p_name, ' ', 2) ELSE 'modern oak thing' END AS title,
       c.url AS source
FROM (SELECT page_id, url, low + page_id % n AS part_key FROM pages CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS low FROM part) k) c
JOIN part ON p_partkey = c.part_key
UNION ALL
SELECT p_partkey, c.page_id, p_name, concat(c.url, '/1200/full.jpg'), 'https://img.example.com/a',
       concat(p_name, ' wood'), 'shop'
FROM (SELECT page_id, url, low + (page_id + 1) % n AS part_key FROM pages CROSS JOIN (SELECT count(*) AS n, min(p_partkey) AS low FROM part) k) c
JOIN part ON p_partkey = c.part_key""")

# Progress manifest of an image job.
_add("v_manifest", ["part"], """
SELECT p_partkey AS product_id, p_name AS product_name,
       CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 + p_partkey % 2 END AS image_count,
       CASE WHEN p_partkey % 3 <> 0 THEN 'success' WHEN p_partkey % 4 = 0 THEN 'no_results'
            WHEN p_partkey % 4 = 1 THEN 'download_failed' WHEN p_partkey % 4 = 2 THEN 'no_good_images' ELSE 'pending' END AS status,
       CASE WHEN p_partkey % 3 <> 0 THEN concat('site', CAST(p_partkey % 20 AS STRING), '.example.com') END AS source_domain
FROM part""")


def view(tables, name: str) -> DataFrame:
    """The view over the tables of one folder, as a DataFrame."""
    sources, sql = VIEWS[name]
    text = sql.replace("{", "{{").replace("}", "}}")
    for s in sources:
        text = re.sub(rf"\b(FROM|JOIN) {s}\b", rf"\1 {{{s}}}", text)
    return tables.spark.sql(text, **{s: getattr(tables, s) for s in sources})


def with_views(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` prefix for reference SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
