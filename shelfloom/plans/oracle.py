"""The registered queries as SQL on the given tables.

Written apart from the Spark operators: only word lists and tables are shared.
"""

from shelfloom import fixed_values as fv
from shelfloom.plans import testviews as tv

ORACLE = {}


def quoted(value) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def pick(values, key) -> str:
    return f"{sql_list(values)}[({key}) % {len(values)} + 1]"


def translate(table, key, default) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {default} END"


def normalized(value) -> str:
    return rf"trim(regexp_replace(coalesce({value}, ''), '\s+', ' ', 'g'))"


def stripped(value) -> str:
    return rf"regexp_replace({value}, '^\s+|\s+$', '', 'g')"


def title(value) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({value}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda x: upper(x[1:1]) || lower(x[2:])), '')"
    )


def unless_blank(value) -> str:
    return f"CASE WHEN lower({value}) NOT IN ('', 'nan', 'none') THEN {value} END"


def attribute(field, raw) -> str:
    text = f"lower({normalized(raw)})"
    table = {"color": fv.COLORS, "size": fv.SIZES, "material": fv.MATERIALS}.get(field)
    other = f"upper({text})" if field == "size" else title(text)
    clean = translate(table, text, other) if table else other
    blank = ", ".join(quoted(w) for w in fv.BLANK_ATTRIBUTE_WORDS)
    return f"CASE WHEN lower({stripped(raw)}) NOT IN ({blank}) THEN {clean} END"


def mentions(text, words) -> str:
    return f"list_filter({sql_list(words)}, lambda w: contains({text}, w))"


def stamp(value) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


SKU = "'SKU-' || p_partkey"

PRODUCTS = f"""
products AS (
  SELECT p_partkey AS product_id, {SKU} AS sku, p_name AS title, p_brand AS brand,
         p_type AS category,
         CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 83.0::DOUBLE ELSE p_retailprice END AS price,
         CASE WHEN p_partkey % 5 = 0 THEN 'INR' ELSE 'USD' END AS currency,
         {attribute('color', pick(tv.RAW_COLORS, 'p_partkey'))} AS color,
         {attribute('size', pick(tv.RAW_SIZES, 'p_partkey'))} AS size,
         {attribute('material', pick(tv.RAW_MATERIALS, 'p_partkey'))} AS material,
         {attribute('weight', "p_size || 'kg'")} AS weight,
         p_type AS ship_class,
         TIMESTAMP '2024-01-01' + to_days(p_size) AS updated_at,
         CASE WHEN p_size <= 10 THEN 'Generated for ' || p_name WHEN p_size <= 20 THEN '' END
           AS generated_description,
         d.text AS description
  FROM part LEFT JOIN documents d ON d.doc_id = p_partkey)"""


def score(source: str, key: str, text: str) -> str:
    """CTEs ending in ``scored`` (key, score, label, word_count, sentence_count, issues)."""
    generic = sql_list(fv.GENERIC_PHRASES)
    return rf"""
counted AS (
  SELECT {key}, {text} AS body,
         len(list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')) AS words,
         len(list_filter(string_split_regex({text}, '[.!?]'), lambda s: regexp_matches(s, '\S'))) AS sentences,
         list_filter({generic}, lambda p: contains(lower({text}), p)) AS generic
  FROM {source}),
pointed AS (
  SELECT *, greatest(0, least(100, 100
      - CASE WHEN words < 20 THEN 40 WHEN words < 50 THEN 20 WHEN words > 300 THEN 10 ELSE 0 END
      - CASE WHEN sentences < 2 THEN 15 ELSE 0 END - 10 * len(generic))) AS points
  FROM counted),
scored AS (
  SELECT {key},
         CASE WHEN coalesce(body, '') = '' THEN 0 ELSE points END::INTEGER AS score,
         CASE WHEN coalesce(body, '') = '' THEN 'Missing' WHEN points >= 80 THEN 'Good'
              WHEN points >= 50 THEN 'Fair' WHEN points >= 20 THEN 'Poor' ELSE 'Critical' END AS label,
         CASE WHEN coalesce(body, '') = '' THEN 0 ELSE words END::INTEGER AS word_count,
         CASE WHEN coalesce(body, '') <> '' THEN sentences END::INTEGER AS sentence_count,
         CASE WHEN coalesce(body, '') = '' THEN ['No description'] ELSE list_filter(
           [CASE WHEN words < 20 THEN 'Very thin content (under 20 words)'
                 WHEN words < 50 THEN 'Short content (under 50 words)'
                 WHEN words > 300 THEN 'Content may be too long (over 300 words)' END,
            CASE WHEN sentences < 2 THEN 'Too few sentences' END], lambda m: m IS NOT NULL)
           || list_transform(generic, lambda p: 'Generic/placeholder text detected: ''' || p || '''')
         END AS issues
  FROM pointed)"""


CONTRADICTIONS = f"""
texts AS (
  SELECT product_id, color, 1 AS nr, 'title' AS source, lower(title) AS body FROM products
  UNION ALL
  SELECT product_id, color, 2, 'description', lower(coalesce(description, '')) FROM products),
colored AS (
  SELECT *, list_filter({mentions('body', fv.KNOWN_COLORS)}, lambda c: c <> lower(color))[1] AS other
  FROM texts WHERE color <> '' AND body <> '' AND NOT contains(body, lower(color))),
contradictions AS (
  SELECT product_id, row_number() OVER (PARTITION BY product_id ORDER BY nr) - 1 AS position,
         'color' AS field, source, color AS expected,
         '''' || other || ''' found in ' || source AS actual
  FROM colored WHERE other IS NOT NULL)"""

ISSUES = f"""{PRODUCTS}, {score('products', 'product_id', 'description')}, {CONTRADICTIONS},
lacking AS (
  SELECT product_id, sku, list_filter([CASE WHEN color IS NULL THEN 'color' END,
    CASE WHEN size IS NULL THEN 'size' END, CASE WHEN material IS NULL THEN 'material' END],
    lambda m: m IS NOT NULL) AS missing FROM products),
loose AS (
  SELECT product_id, 0 AS nr, 'missing_description' AS issue_type, 'high' AS severity,
         'Product ''' || sku || ''' has no description. SEO content generation recommended.' AS description,
         'description' AS field_name, NULL::VARCHAR AS expected_value, NULL::VARCHAR AS actual_value
  FROM products WHERE coalesce(description, '') = ''
  UNION ALL
  SELECT product_id, 0, 'thin_content', 'medium',
         'Product ''' || sku || ''' has thin content (score: ' || score || '/100, ' || word_count
           || ' words). Issues: ' || array_to_string(issues, ', '),
         'description', NULL, word_count || ' words'
  FROM products JOIN scored USING (product_id)
  WHERE coalesce(products.description, '') <> '' AND score < 50
  UNION ALL
  SELECT product_id, 1 + position, 'attribute_contradiction', 'high',
         'Contradiction detected in ''' || field || ''': attribute says ''' || expected || ''' but ' || actual,
         field, expected, actual
  FROM contradictions
  UNION ALL
  SELECT product_id, 9, 'missing_attributes', 'low',
         'Product ''' || sku || ''' is missing attributes: ' || array_to_string(missing, ', ')
           || '. Adding these can improve content quality.',
         array_to_string(missing, ', '), NULL, NULL
  FROM lacking WHERE len(missing) >= 2),
issues AS (
  SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY nr) - 1)::INTEGER AS position,
         issue_type, severity, description, field_name, expected_value, actual_value
  FROM loose),
issue_table AS (
  SELECT product_id * 10 + position AS issue_id, *,
         issue_type = 'missing_attributes' AS resolved,
         CASE WHEN issue_type = 'missing_attributes' THEN TIMESTAMP '2024-01-01' END AS resolved_at
  FROM issues)"""

PRICES = f"""
unit_prices AS (
  SELECT *, {pick(fv.SOURCES, 'l_suppkey')} AS source, l_extendedprice / l_quantity AS unit FROM lineitem),
prices AS (
  SELECT l_orderkey * 8 + l_linenumber AS price_id, l_partkey AS product_id, source,
         'Listing ' || l_orderkey AS competitor_title,
         CASE WHEN l_tax = 0.08::DOUBLE THEN NULL WHEN l_tax = 0.07::DOUBLE THEN 0.0::DOUBLE
              WHEN source = 'flipkart' THEN unit * 83.0::DOUBLE ELSE unit END AS competitor_price,
         CASE WHEN source = 'flipkart' THEN 'INR' ELSE 'USD' END AS competitor_currency,
         CASE WHEN l_returnflag = 'R' THEN false WHEN l_linenumber = 6 THEN NULL ELSE true END AS in_stock,
         l_shipdate + to_seconds(l_suppkey) AS scraped_at
  FROM unit_prices)"""

ALERTS = f"""{PRODUCTS}, {PRICES},
looked AS (
  SELECT *, lag(competitor_price) OVER (PARTITION BY product_id, source ORDER BY scraped_at, price_id)
            AS previous
  FROM prices WHERE competitor_price IS NOT NULL),
compared AS (
  SELECT l.*, p.price AS ours, p.currency AS our_currency,
         upper(source[1:1]) || source[2:] AS name,
         CASE WHEN competitor_currency = 'INR' AND p.currency = 'USD' THEN competitor_price / 83.0::DOUBLE
              WHEN competitor_currency = 'USD' AND p.currency = 'INR' THEN competitor_price * 83.0::DOUBLE
              ELSE competitor_price END AS fx,
         CASE WHEN previous <> 0
              THEN abs((competitor_price - previous) / previous) * 100 END AS change
  FROM looked l JOIN products p USING (product_id)
  WHERE competitor_price <> 0 AND p.price <> 0),
alerts AS (
  SELECT product_id, 'undercut' AS alert_type, source,
         name || ' is selling a similar product at ' || competitor_currency || ' '
           || printf('%.2f', competitor_price) || ', which is ' || printf('%.1f', ((ours - fx) / ours) * 100)
           || '% lower than your price of ' || our_currency || ' ' || printf('%.2f', ours) || '.' AS message,
         ours AS our_price, competitor_price, ours - fx AS price_difference, scraped_at
  FROM compared WHERE fx < ours AND ((ours - fx) / ours) * 100 >= 5
  UNION ALL
  SELECT product_id, 'out_of_stock', source,
         'Competitor on ' || name || ' is OUT OF STOCK for a similar product. '
           || 'This is a buying opportunity — consider promoting your listing.',
         ours, competitor_price, NULL, scraped_at
  FROM compared WHERE in_stock IS NOT TRUE
  UNION ALL
  SELECT product_id, CASE WHEN competitor_price < previous THEN 'price_drop' ELSE 'price_increase' END, source,
         'Competitor on ' || name
           || CASE WHEN competitor_price < previous THEN ' dropped' ELSE ' increased' END
           || ' price by ' || printf('%.1f', change) || '% (from ' || printf('%.2f', previous) || ' to '
           || printf('%.2f', competitor_price) || ').',
         ours, competitor_price, abs(competitor_price - previous), scraped_at
  FROM compared WHERE change >= 10)"""

SEARCH = """
queried AS (
  SELECT *, CASE WHEN starts_with(lower(title), lower(brand)) THEN title ELSE brand || ' ' || title END AS query
  FROM products),
sources AS (SELECT unnest(['amazon', 'walmart', 'flipkart']) AS source),
targets AS (
  SELECT queried.*, source, CASE source WHEN 'amazon' THEN 'https://www.amazon.com/s?k='
         WHEN 'walmart' THEN 'https://www.walmart.com/search?q='
         ELSE 'https://www.flipkart.com/search?q=' END || replace(query, ' ', '+') AS search_url
  FROM queried, sources)"""

# What the marketplace blocks put on the pages must read as.
LISTINGS = """
listings AS (
  SELECT page_id, page_id AS product_id, ['amazon', 'walmart', 'flipkart'][page_id % 3 + 1] AS source,
         (CASE WHEN n = 0 THEN 0 ELSE n - 1 END)::INTEGER AS listing_rank,
         'Offer ' || n || ' of ' || page_id AS title,
         CASE page_id % 3 WHEN 0 THEN ('1' || page_id || '.' || n || '5')::DOUBLE
              WHEN 1 THEN (page_id || '.' || n || '0')::DOUBLE
              ELSE (page_id || n || '00')::DOUBLE END AS price,
         CASE page_id % 3 WHEN 2 THEN 'INR' ELSE 'USD' END AS currency, true AS in_stock,
         CASE page_id % 3 WHEN 0 THEN 'https://www.amazon.com/dp/' WHEN 1 THEN 'https://www.walmart.com/ip/'
              ELSE 'https://www.flipkart.com/p/' END || page_id || '-' || n AS url
  FROM pages, (SELECT unnest([0, 2, 3, 4]) AS n)
  WHERE page_id % 8 <> 7)"""

FEED = f"""
cells AS (
  SELECT CASE WHEN p_size = 13 THEN 'None' ELSE ' ' || {SKU} END AS product_code,
         CASE WHEN p_size = 7 THEN 'nan' ELSE '  ' || replace(p_name, ' ', '  ') || ' ' END AS name,
         d.text AS details,
         CASE WHEN p_size = 9 THEN 'N/A' ELSE p_type END AS department, p_brand AS vendor,
         replace({pick(tv.RAW_PRICES, 'p_partkey')}, '%', p_retailprice::VARCHAR) AS list_price,
         CASE WHEN p_size < 25 THEN 'eur' END AS currency_code,
         {pick(tv.RAW_COLORS, 'p_partkey')} AS colour, {pick(tv.RAW_SIZES, 'p_partkey')} AS sizes,
         {pick(tv.RAW_MATERIALS, 'p_partkey')} AS fabric, p_size || 'kg' AS shipping_weight,
         CASE WHEN p_size < 40 THEN ' ' || p_type ELSE 'none' END AS ship_class
  FROM part LEFT JOIN documents d ON d.doc_id = p_partkey),
feed AS (
  SELECT {", ".join(f"CASE WHEN {c} NOT IN ({', '.join(quoted(t) for t in fv.NA_TOKENS)}) THEN {c} END AS {c}"
                    for c in ["product_code", "name", "details", "department", "vendor", "list_price",
                              "currency_code", "colour", "sizes", "fabric", "shipping_weight", "ship_class"])}
  FROM cells),
typed AS (
  SELECT *, {stripped('product_code')} AS code, {normalized('name')} AS clean_name,
         {normalized('details')} AS clean_details, {normalized('department')} AS clean_department,
         {normalized('vendor')} AS clean_vendor,
         {stripped("replace(replace(list_price, ',', ''), '$', '')")} AS number,
         {attribute('color', 'colour')} AS color, {attribute('size', 'sizes')} AS size,
         {attribute('material', 'fabric')} AS material, {attribute('weight', 'shipping_weight')} AS weight,
         {unless_blank(stripped('ship_class'))} AS extra
  FROM feed),
clean AS (
  SELECT code AS sku, coalesce({unless_blank('clean_name')}, code) AS title,
         md5({unless_blank('clean_details')}) AS description,
         {unless_blank('clean_department')} AS category, {unless_blank('clean_vendor')} AS brand,
         CASE WHEN regexp_full_match(number, '[0-9]+[.]?[0-9]*') THEN number::DOUBLE END AS price,
         coalesce(upper(currency_code), 'USD') AS currency,
         array_to_string(list_sort(list_filter([
           'color=' || color, 'size=' || size, 'material=' || material, 'weight=' || weight,
           'ship_class=' || extra], lambda a: a IS NOT NULL)), ';') AS attributes
  FROM typed WHERE code NOT IN ('', 'None') AND code IS NOT NULL)"""

LONG_WORDS = len(tv.LONG_TEXT.split())
assert 20 <= LONG_WORDS < 50

UPDATES = f"""
catalog AS (
  SELECT {SKU} AS sku, p_name AS title, p_brand AS brand, p_type AS category,
         CASE WHEN p_partkey % 5 = 0 THEN p_retailprice * 83.0::DOUBLE ELSE p_retailprice END AS price,
         CASE WHEN p_partkey % 5 = 0 THEN 'INR' ELSE 'USD' END AS currency,
         CASE WHEN p_size <= 10 THEN 'Generated for ' || p_name WHEN p_size <= 20 THEN '' END
           AS generated_description,
         TIMESTAMP '2024-01-01' + to_days(p_size) AS updated_at,
         {attribute('color', pick(tv.RAW_COLORS, 'p_partkey'))} AS color,
         {attribute('size', pick(tv.RAW_SIZES, 'p_partkey'))} AS size,
         {attribute('material', pick(tv.RAW_MATERIALS, 'p_partkey'))} AS material,
         {attribute('weight', "p_size || 'kg'")} AS weight, p_type AS ship_class
  FROM part),
lines AS (
  SELECT CASE WHEN l_returnflag = 'N' THEN 'NEW-' || l_suppkey ELSE 'SKU-' || l_partkey END AS sku,
         'Item ' || l_linenumber AS title,
         CASE WHEN l_linestatus = 'F' THEN {quoted(tv.LONG_TEXT)} END AS description,
         CASE WHEN l_tax > 0.04::DOUBLE THEN 'Updated' END AS category, 'Brand ' || l_returnflag AS brand,
         CASE WHEN l_tax < 0.08::DOUBLE THEN l_extendedprice END AS price,
         CASE WHEN l_discount > 0.05::DOUBLE THEN 'INR' ELSE 'USD' END AS currency, l_linestatus AS size,
         CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS issue_count,
         row_number() OVER (PARTITION BY CASE WHEN l_returnflag = 'N' THEN 'NEW-' || l_suppkey
                                              ELSE 'SKU-' || l_partkey END
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS nr,
         count(*) OVER (PARTITION BY CASE WHEN l_returnflag = 'N' THEN 'NEW-' || l_suppkey
                                          ELSE 'SKU-' || l_partkey END) AS line_count
  FROM lineitem),
latest AS (
  SELECT z.* REPLACE (a.currency AS currency)
  FROM lines z JOIN lines a ON a.sku = z.sku AND a.nr = 1 WHERE z.nr = z.line_count),
upserted AS (
  SELECT coalesce(c.sku, f.sku) AS sku,
         CASE WHEN f.sku IS NULL THEN c.title ELSE f.title END AS title,
         f.description,
         CASE WHEN f.sku IS NULL THEN c.category ELSE f.category END AS category,
         CASE WHEN f.sku IS NULL THEN c.brand ELSE f.brand END AS brand,
         CASE WHEN f.sku IS NULL THEN c.price ELSE f.price END AS price,
         coalesce(c.currency, f.currency) AS currency,
         CASE WHEN f.sku IS NULL THEN 'draft' WHEN f.issue_count > 0 THEN 'flagged' ELSE 'active' END AS status,
         c.generated_description,
         {stamp("CASE WHEN f.sku IS NULL THEN c.updated_at ELSE TIMESTAMP '2024-06-01' END")} AS updated_at,
         CASE WHEN f.sku IS NULL THEN array_to_string(list_sort(list_filter([
             'color=' || c.color, 'size=' || c.size, 'material=' || c.material, 'weight=' || c.weight,
             'ship_class=' || c.ship_class], lambda a: a IS NOT NULL)), ';')
              ELSE 'color=Black;size=' || f.size END AS attributes
  FROM catalog c FULL OUTER JOIN latest f ON c.sku = f.sku)"""

GENERATED = f"""{PRODUCTS},
results AS (
  SELECT product_id,
         CASE WHEN category = 'PROMO' THEN '' ELSE 'About ' || title || ' (' || sku || ').' END
           AS generated_description,
         CASE WHEN category NOT IN ('PROMO', 'LARGE') THEN title END AS seo_title,
         CASE WHEN category NOT IN ('PROMO', 'LARGE') THEN brand END AS seo_keywords,
         category <> 'PROMO' AS success,
         CASE WHEN category = 'PROMO'
              THEN 'Content generation failed for product ' || product_id || ': refused' END AS error
  FROM products
  UNION ALL
  SELECT -s_suppkey - 1, '', NULL, NULL, false, 'Product with ID ' || (-s_suppkey - 1) || ' not found.'
  FROM supplier)"""


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLE[name] = f"WITH {ctes.strip()} {select}" if ctes else select


# --- text and attributes ---
oracle("q_text_normalize", "", f"""
SELECT doc_id, length(clean) AS chars, md5(clean) AS digest
FROM (SELECT doc_id, {normalized('text')} AS clean FROM documents)""")
titled = title("'levi''s 0.8kg-' || upper(p_name) || '-' || lower(p_brand)")
oracle("q_title_case", "", f"SELECT p_partkey, {titled} AS titled FROM part")
oracle("q_attr_normalize", PRODUCTS,
       "SELECT product_id, color, size, material, weight, ship_class FROM products")
oracle("q_attr_dictionary", """
dictionary AS (SELECT lower(p_brand) AS variant, min(p_type) AS canonical FROM part
               GROUP BY 1)""", f"""
SELECT p_partkey, coalesce(canonical, {title('lower(p_brand)')}) AS brand
FROM part LEFT JOIN dictionary ON variant = lower(p_brand)""")
tokens = ", ".join(quoted(t) for t in fv.NA_TOKENS)
oracle("q_na_tokens", f"""
raws AS (SELECT p_partkey, {pick(tv.RAW_TOKENS, 'p_partkey')} AS raw FROM part),
keep AS (SELECT *, CASE WHEN raw NOT IN ({tokens}) THEN raw END AS kept FROM raws),
tidy AS (SELECT *, {normalized('kept')} AS neat FROM keep)""",
       f"SELECT p_partkey, raw, kept, {unless_blank('neat')} AS filled FROM tidy")

# --- quality ---
oracle("q_content_score", score("documents", "doc_id", "text"), """
SELECT doc_id, score, label, word_count, sentence_count, array_to_string(issues, '; ') AS issues FROM scored""")
oracle("q_content_label_counts", score("documents", "doc_id", "text"),
       "SELECT label, count(*) AS documents FROM scored GROUP BY label")
oracle("q_contradictions", f"{PRODUCTS}, {CONTRADICTIONS}",
       "SELECT product_id, position::INTEGER AS position, field, source, expected, actual FROM contradictions")


def plain_words(text: str) -> str:
    """Lower-cased words with a space between, before and behind them."""
    return f"""(' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')"""


oracle("q_word_contradictions", f"""{PRODUCTS},
texts AS (
  SELECT product_id, color, 1 AS nr, 'title' AS source, {plain_words('title')} AS body FROM products
  UNION ALL SELECT product_id, color, 2, 'description', {plain_words("coalesce(description, '')")} FROM products),
colored AS (
  SELECT *, trim(list_filter({mentions('body', [f' {c} ' for c in fv.KNOWN_COLORS])}, lambda c: trim(c) <> lower(color))[1]) AS other
  FROM texts WHERE color <> '' AND body <> '  ' AND NOT contains(body, {plain_words('color')}))""", """
SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY nr) - 1)::INTEGER AS position,
       'color' AS field, source, color AS expected, '\'\'' || other || '\'\' found in ' || source AS actual
FROM colored WHERE other IS NOT NULL""".replace("\\'", "'"))
oracle("q_dictionary_contradictions", f"""
dictionary AS (
  SELECT {plain_words('word')} AS gram, min(lower(word)) AS place FROM (
    SELECT split_part(p_name, ' ', 1) AS word FROM part UNION SELECT p_name FROM part UNION SELECT p_brand FROM part)
  GROUP BY 1),
spoken AS (
  SELECT *, {plain_words('value')} AS own FROM (
    SELECT p_partkey AS product_id, 'title' AS source, {plain_words('p_name')} AS said,
           CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE split_part(p_name, ' ', -1) END AS value FROM part
    UNION ALL SELECT p_partkey, 'description', {plain_words("p_brand || ' - ' || p_type")},
           CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE split_part(p_name, ' ', -1) END FROM part))""", """
SELECT product_id, 'finish' AS field, source, value AS expected,
       '\'\'' || trim(first(gram ORDER BY place, gram)) || '\'\' found in ' || source AS actual
FROM spoken JOIN dictionary ON contains(said, gram) WHERE NOT contains(said, own)
GROUP BY product_id, source, value""".replace("\\'", "'"))
oracle("q_issues", ISSUES, "SELECT * FROM issues")
oracle("q_issue_summary", ISSUES,
       "SELECT issue_type, severity, count(*) AS issues FROM issues GROUP BY ALL")
oracle("q_product_status", ISSUES, """
SELECT p.product_id, count(i.product_id)::INTEGER AS issue_count,
       CASE WHEN count(i.product_id) > 0 THEN 'flagged' ELSE 'active' END AS status
FROM products p LEFT JOIN issues i ON i.product_id = p.product_id GROUP BY p.product_id""")

# --- feeds and upsert ---
for name in ("q_feed_clean", "q_csv_feed", "q_csv_one_file", "q_stream_feed"):
    oracle(name, FEED, "SELECT * FROM clean")
oracle("q_raw_data", FEED, """
SELECT code AS sku, product_code, name, list_price, colour, ship_class
FROM typed WHERE code NOT IN ('', 'None') AND code IS NOT NULL""")
oracle("q_upsert", UPDATES, "SELECT * FROM upserted")
oracle("q_upsert_counters", UPDATES, """
SELECT count(*) AS processed_rows,
       count(DISTINCT sku) FILTER (sku NOT IN (SELECT sku FROM catalog)) AS new_products,
       count(*) - count(DISTINCT sku) FILTER (sku NOT IN (SELECT sku FROM catalog)) AS updated_products,
       sum(issue_count)::BIGINT AS issues_found FROM lines""")
oracle("q_create_reject_dup", """
requested AS (
  SELECT CASE WHEN s_acctbal > 0 THEN 'SKU-' || s_suppkey ELSE s_name END AS sku, s_name AS title
  FROM supplier),
known AS (SELECT 'SKU-' || p_partkey AS sku FROM part)""", """
SELECT sku, title, CASE WHEN sku NOT IN (FROM known) THEN 'USD' END AS currency,
       CASE WHEN sku NOT IN (FROM known) THEN 'draft' ELSE 'rejected' END AS status FROM requested""")
oracle("q_patch", """
ranked AS (
  SELECT l_partkey AS product_id, CASE WHEN l_tax < 0.08::DOUBLE THEN l_extendedprice END AS price,
         CASE WHEN l_discount > 0.02::DOUBLE THEN l_linestatus END AS category, l_tax > 0.04::DOUBLE AS sets_category,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) AS nr,
         row_number() OVER (PARTITION BY l_partkey, l_tax > 0.04::DOUBLE
                            ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_shipdate DESC, l_extendedprice DESC) AS category_nr
  FROM lineitem),
price_set AS (SELECT product_id, price FROM ranked WHERE nr = 1),
category_set AS (SELECT product_id, category FROM ranked WHERE sets_category AND category_nr = 1),
""" + PRODUCTS.strip() + """,
joined AS (
  SELECT p.product_id, p.title, CASE WHEN a.product_id IS NULL THEN p.price ELSE a.price END AS price,
         CASE WHEN c.product_id IS NULL THEN p.category ELSE c.category END AS category,
         p.price AS old_price, p.category AS old_category, p.updated_at AS old_updated
  FROM products p LEFT JOIN price_set a ON a.product_id = p.product_id
                  LEFT JOIN category_set c ON c.product_id = p.product_id)""", f"""
SELECT product_id, title, price, category, {stamp('''CASE WHEN price IS DISTINCT FROM old_price
  OR category IS DISTINCT FROM old_category THEN TIMESTAMP '2024-06-01' ELSE old_updated END''')} AS updated_at
FROM joined""")
oracle("q_delete_cascade", f"{ISSUES}, {PRICES}", """
SELECT 'products' AS table_name, count(*) AS rows, sum(product_id)::BIGINT AS id_sum
FROM products WHERE category <> 'PROMO'
UNION ALL SELECT 'issues', count(*), sum(product_id)::BIGINT FROM issues
WHERE product_id NOT IN (SELECT product_id FROM products WHERE category = 'PROMO')
UNION ALL SELECT 'prices', count(*), sum(product_id)::BIGINT FROM prices
WHERE product_id NOT IN (SELECT product_id FROM products WHERE category = 'PROMO')""")
oracle("q_resolve_issues", ISSUES, f"""
SELECT issue_id, issue_type, resolved OR issue_id IN (SELECT s_suppkey FROM supplier) AS resolved,
       {stamp('''CASE WHEN issue_id IN (SELECT s_suppkey FROM supplier) THEN TIMESTAMP '2024-06-01'
       ELSE resolved_at END''')} AS resolved_at FROM issue_table""")
oracle("q_ack_alerts", "", f"""
SELECT o_orderkey AS alert_id, o_custkey AS product_id,
       o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem) AS acknowledged,
       {stamp('o_orderdate')} AS created_at FROM orders""")

# --- catalog reads ---
oracle("q_list_search_page", ISSUES, f"""
SELECT p.product_id, sku, title, brand, {stamp('updated_at')} AS updated_at,
       (SELECT count(*) FROM issue_table i WHERE i.product_id = p.product_id AND NOT resolved) AS issue_count
FROM (SELECT * FROM products WHERE title ILIKE '%RED%' OR sku ILIKE '%RED%' OR brand ILIKE '%RED%'
      ORDER BY updated_at DESC, product_id LIMIT 50 OFFSET 50) p""")
oracle("q_keyset_page", PRODUCTS, f"""
SELECT product_id, {stamp('updated_at')} AS updated_at FROM products
WHERE category = 'ECONOMY' AND (updated_at < TIMESTAMP '2024-01-31'
      OR (updated_at = TIMESTAMP '2024-01-31' AND product_id > 5))
ORDER BY products.updated_at DESC, product_id LIMIT 100""")
oracle("q_filter_category", PRODUCTS, """
SELECT product_id, title, category FROM products WHERE category = 'STANDARD'
AND (title ILIKE '%_ew %%' OR sku ILIKE '%_ew %%' OR brand ILIKE '%_ew %%')""")
oracle("q_lookup_by_id_and_sku", PRODUCTS, """
SELECT 'id' AS found_by, product_id, sku FROM products WHERE product_id IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'sku', product_id, sku FROM products
WHERE sku IN (SELECT 'SKU-' || s_suppkey FROM supplier)""")
oracle("q_issue_counts", ISSUES, """
SELECT p.product_id, count(*) FILTER (NOT resolved) AS issue_count
FROM products p LEFT JOIN issue_table i ON i.product_id = p.product_id GROUP BY p.product_id""")
oracle("q_product_issues", ISSUES, """
SELECT issue_id, product_id, issue_type, severity, resolved FROM issue_table
WHERE product_id IN (SELECT product_id FROM products WHERE category = 'SMALL')""")
oracle("q_issue_list", ISSUES, """
SELECT issue_id, issue_type, severity FROM issue_table WHERE NOT resolved ORDER BY issue_id DESC LIMIT 100""")
oracle("q_job_list", "", f"""
SELECT o_orderkey AS job_id, o_orderpriority AS filename, o_orderstatus AS status,
       {stamp('o_orderdate')} AS started_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""")
oracle("q_categories", "", "SELECT DISTINCT p_type AS category FROM part WHERE p_type IS NOT NULL")
oracle("q_dashboard_stats", f"{ISSUES}, {PRICES}", f"""
SELECT (SELECT count(*) FROM products) AS total_products,
       (SELECT count(*) FROM products WHERE product_id NOT IN (SELECT product_id FROM issues)) AS active_products,
       (SELECT count(DISTINCT product_id) FROM issues) AS flagged_products,
       (SELECT count(*) FROM products WHERE coalesce(description, '') = ''
          AND coalesce(generated_description, '') = '') AS products_without_description,
       (SELECT count(*) FROM issue_table WHERE NOT resolved) AS open_issues,
       (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS recent_alerts,
       (SELECT {stamp('max(o_orderdate)')} FROM orders) AS last_ingestion,
       (SELECT {stamp('max(scraped_at)')} FROM prices) AS last_scrape""")
NEEDS = "coalesce(description, '') = '' OR generated_description IS NULL"
oracle("q_needs_content", PRODUCTS, f"""
SELECT product_id, sku, title FROM products WHERE {NEEDS} ORDER BY product_id LIMIT 50""")
oracle("q_all_needing_content", PRODUCTS, f"SELECT product_id, sku FROM products WHERE {NEEDS}")
oracle("q_open_content_issues", ISSUES, """
SELECT issue_id, issue_type FROM issue_table
WHERE issue_type IN ('missing_description', 'thin_content') AND NOT resolved
  AND product_id IN (SELECT product_id FROM products WHERE category = 'LARGE')""")
oracle("q_duplicate_titles", PRODUCTS, """
SELECT lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title, count(DISTINCT sku) AS skus
FROM products GROUP BY 1 HAVING count(DISTINCT sku) > 1""")

# --- prices ---
oracle("q_search_query_url", f"""{PRODUCTS},
branded AS (
  SELECT product_id, title, {pick(['amazon', 'Walmart', 'FLIPKART', 'elsewhere'], 'product_id')} AS source,
         trim(coalesce(CASE category WHEN 'PROMO' THEN title[1:3] WHEN 'SMALL' THEN ' '
                       WHEN 'LARGE' THEN NULL ELSE brand END, '')) AS brand
  FROM products),
asked AS (
  SELECT *, CASE WHEN brand <> '' AND starts_with(lower(title), lower(brand)) THEN title
                 ELSE trim(brand || ' ' || title) END AS query FROM branded)""", """
SELECT product_id, query, CASE lower(source) WHEN 'walmart' THEN 'https://www.walmart.com/search?q='
       WHEN 'flipkart' THEN 'https://www.flipkart.com/search?q=' ELSE 'https://www.amazon.com/s?k=' END
       || replace(query, ' ', '+') AS url FROM asked""")
oracle("q_products_x_sources", f"{PRODUCTS}, {SEARCH}",
       "SELECT product_id, source, search_url FROM targets WHERE category <> 'PROMO'")
SHOWN = ["$%", "Rs. %,500", "% / 2.5", "from %.", "1,%", "call us", "", "%.%.%"]
oracle("q_price_extract", f"""
shown_prices AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         replace({pick(SHOWN, 'l_suppkey')}, '%', l_quantity::INTEGER::VARCHAR) AS shown
  FROM lineitem)""", r"""
SELECT *, TRY_CAST(replace(regexp_replace(regexp_extract(shown, '[0-9][0-9,.]*'), '[.]+$', ''), ',', '') AS DOUBLE)
  AS price FROM shown_prices""")
oracle("q_feed_price", f"""
raws AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         replace({pick(tv.RAW_PRICES, 'l_suppkey')}, '%', l_quantity::VARCHAR) AS raw FROM lineitem)""", f"""
SELECT *, TRY_CAST({stripped("replace(replace(raw, ',', ''), '$', '')")} AS DOUBLE) AS price FROM raws""")
oracle("q_fx_normalized", f"""{PRODUCTS}, {PRICES},
joined AS (
  SELECT c.*, p.price AS ours,
         CASE WHEN competitor_currency = 'INR' AND currency = 'USD' THEN competitor_price / 83.0::DOUBLE
              WHEN competitor_currency = 'USD' AND currency = 'INR' THEN competitor_price * 83.0::DOUBLE
              ELSE competitor_price END AS fx
  FROM prices c JOIN products p USING (product_id) WHERE competitor_price IS NOT NULL)""", f"""
SELECT price_id, product_id, {stamp('scraped_at')} AS scraped_at, fx AS in_our_currency,
       CASE WHEN ours <> 0 THEN ((ours - fx) / ours) * 100 END AS below_percent FROM joined""")
oracle("q_prev_price", PRICES, f"""
SELECT price_id, product_id, source, {stamp('scraped_at')} AS scraped_at, competitor_price,
       lag(competitor_price) OVER (PARTITION BY product_id, source ORDER BY prices.scraped_at, price_id)
         AS previous_price
FROM prices WHERE competitor_price IS NOT NULL""")
KIND = f"""SELECT product_id, alert_type, source, our_price, competitor_price, price_difference,
       {stamp('scraped_at')} AS created_at FROM alerts WHERE alert_type IN """
oracle("q_alert_undercut", ALERTS, KIND + "('undercut')")
oracle("q_alert_oos", ALERTS, KIND + "('out_of_stock')")
oracle("q_alert_change", ALERTS, KIND + "('price_drop', 'price_increase')")
oracle("q_alerts_all", ALERTS, """
SELECT alert_type, source, count(*) AS alerts, max(price_difference) AS largest FROM alerts GROUP BY ALL""")
oracle("q_alert_messages", ALERTS, f"""
SELECT product_id, source, alert_type, {stamp('scraped_at')} AS created_at, message FROM alerts""")
oracle("q_alerts_sliced", ALERTS, """
SELECT product_id, alert_type, count(*) AS alerts, max(price_difference) AS largest FROM alerts GROUP BY ALL""")
oracle("q_alerts_hot_series", ALERTS.replace(
    "prices AS (\n  SELECT l_orderkey * 8 + l_linenumber AS price_id, l_partkey AS product_id,",
    "prices AS (\n  SELECT l_orderkey * 8 + l_linenumber AS price_id, "
    "CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_partkey END AS product_id,"), """
SELECT alert_type, source, count(*) AS alerts, max(price_difference) AS largest,
       count(*) FILTER (product_id = 0) AS of_product_0 FROM alerts GROUP BY alert_type, source""")
oracle("q_batch_alerts", ALERTS, f"""
SELECT product_id, source, alert_type, price_difference, {stamp('scraped_at')} AS created_at
FROM alerts WHERE scraped_at >= TIMESTAMP '2000-01-01'""")
oracle("q_latest_prices", PRICES, f"""
SELECT product_id, source, price_id, competitor_price, competitor_currency, {stamp('scraped_at')} AS scraped_at
FROM prices WHERE competitor_price IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY product_id, source
                           ORDER BY prices.scraped_at DESC, price_id DESC) = 1""")
oracle("q_price_list", PRICES, f"""
SELECT price_id, product_id, source, competitor_price, {stamp('scraped_at')} AS scraped_at
FROM prices WHERE source = 'walmart' ORDER BY prices.scraped_at DESC, price_id DESC LIMIT 50""")
oracle("q_alert_list", "", f"""
SELECT o_orderkey AS alert_id, o_custkey AS product_id, {stamp('o_orderdate')} AS created_at
FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50""")
oracle("q_price_comparison", f"""{PRODUCTS}, {PRICES},
top AS (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, price_id DESC) AS nr FROM prices)""", """
SELECT product_id, 0 AS position, 'Your Price' AS name, 'ours' AS source, coalesce(price, 0) AS price, currency
FROM products WHERE product_id IN (SELECT product_id FROM prices)
UNION ALL
SELECT product_id, nr::INTEGER, upper(source[1:1]) || source[2:], source, competitor_price, competitor_currency
FROM top WHERE nr <= 10 AND competitor_price <> 0 AND product_id IN (SELECT product_id FROM products)""")
oracle("q_back_in_stock", f"""{PRICES},
looked AS (
  SELECT *, lag(in_stock) OVER (PARTITION BY product_id, source ORDER BY scraped_at, price_id) AS before
  FROM prices)""", f"""
SELECT price_id, product_id, source, {stamp('scraped_at')} AS scraped_at FROM looked WHERE in_stock AND NOT before""")

# --- marketplace pages ---
oracle("q_page_listings", LISTINGS, "SELECT * FROM listings")
BEST = f"""{PRODUCTS}, {SEARCH}, {LISTINGS},
best AS (SELECT * FROM listings WHERE listing_rank = 0)"""
oracle("q_snapshots", BEST, """
SELECT product_id, source, title AS competitor_title, url AS competitor_url, price AS competitor_price,
       currency AS competitor_currency, in_stock, '2024-06-01 00:00:00' AS scraped_at
FROM best WHERE product_id IN (SELECT product_id FROM products)""")
oracle("q_unmatched_listings", BEST, """
SELECT product_id, source, search_url FROM targets t
WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.product_id = t.product_id AND b.source = t.source)""")
oracle("q_scrape_summary", f"""{BEST},
compared AS (
  SELECT CASE WHEN b.currency = 'INR' AND p.currency = 'USD' THEN b.price / 83.0::DOUBLE
              WHEN b.currency = 'USD' AND p.currency = 'INR' THEN b.price * 83.0::DOUBLE ELSE b.price END AS fx,
         p.price AS ours, b.price AS theirs
  FROM best b JOIN products p USING (product_id))""", """
SELECT (SELECT count(*) FROM products)::BIGINT AS products_scraped, count(*)::BIGINT AS results_found,
       count(*) FILTER (theirs <> 0 AND fx < ours AND ((ours - fx) / ours) * 100 >= 5)::BIGINT AS alerts_generated
FROM compared""")

# --- generated content ---
head, tail = fv.DESCRIPTION_PROMPT.replace("{tone}", "luxury").split("{title}")
after_title = tail.split("{sku}")[1]
after_price = after_title.split("{currency}")[1]
PROMPT = f"""
{quoted(head)} || title || {quoted(tail.split('{sku}')[0])} || sku || {quoted(after_title.split('{category}')[0])}
 || category || {quoted(after_title.split('{category}')[1].split('{brand}')[0])} || brand
 || {quoted(after_title.split('{brand}')[1].split('{price}')[0])} || price::VARCHAR || ' ' || currency
 || {quoted(after_price.split('{original}')[0])}
 || CASE WHEN coalesce(description, '') <> '' THEN '- Original Description: ' || description ELSE '' END
 || {quoted(after_price.split('{original}')[1].split('{attributes}')[0])}
 || coalesce('  - Color: ' || color || chr(10), '') || coalesce('  - Size: ' || size || chr(10), '')
 || coalesce('  - Material: ' || material || chr(10), '') || '  - Weight: ' || weight || chr(10)
 || '  - Ship Class: ' || ship_class || chr(10) || {quoted(after_price.split('{attributes}')[1])}"""
oracle("q_prompts", f"{PRODUCTS}, prompts AS (SELECT product_id, {PROMPT} AS prompt FROM products)",
       "SELECT product_id, length(prompt) AS chars, md5(prompt) AS digest FROM prompts")
seo = fv.SEO_PROMPT.replace("{{", "{").replace("}}", "}")
seo_parts = [seo.split("{title}")[0], seo.split("{title}")[1].split("{category}")[0],
             seo.split("{category}")[1].split("{brand}")[0], seo.split("{brand}")[1].split("{description}")[0],
             seo.split("{description}")[1]]
oracle("q_seo_prompts", PRODUCTS, f"""
SELECT product_id, {quoted(seo_parts[0])} || title || {quoted(seo_parts[1])}
  || CASE WHEN category = 'PROMO' THEN 'General' ELSE category END || {quoted(seo_parts[2])}
  || CASE WHEN category = 'SMALL' THEN 'Unknown' ELSE brand END || {quoted(seo_parts[3])} || sku
  || {quoted(seo_parts[4])} AS prompt FROM products""")
oracle("q_seo_parse", "", """
SELECT p_partkey, p_partkey % 8 NOT IN (2, 3) AS parsed, p_partkey % 8 <> 5 AS usable,
       CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 4 THEN p_name WHEN 6 THEN p_name
            WHEN 7 THEN '' END AS seo_title,
       CASE p_partkey % 8 WHEN 0 THEN 'one, two,' || p_name || ' , three' WHEN 1 THEN 'fenced' WHEN 4 THEN ''
            WHEN 7 THEN 'x,,y' END AS seo_keywords
FROM part""")
oracle("q_seo_keywords", "", """
SELECT p_partkey, unnest(range(4))::INTEGER AS position, unnest(['a', p_name, '', p_brand]) AS keyword FROM part""")
oracle("q_display_description", PRODUCTS, """
SELECT product_id, md5(CASE WHEN generated_description <> '' THEN generated_description ELSE description END)
  AS digest FROM products""")
for name in ("q_generate_stub", "q_generate_ledger"):
    oracle(name, GENERATED, "SELECT * FROM results")
oracle("q_generate_counts", GENERATED,
       "SELECT count(*) FILTER (success) AS succeeded, count(*) AS requested FROM results")
oracle("q_store_content", GENERATED, f"""
SELECT product_id, CASE WHEN r.success THEN r.generated_description ELSE p.generated_description END
         AS generated_description,
       CASE WHEN r.success THEN r.seo_title ELSE 'old' END AS seo_title,
       CASE WHEN r.success THEN r.seo_keywords END AS seo_keywords,
       {stamp("CASE WHEN r.success THEN TIMESTAMP '2024-06-01' ELSE updated_at END")} AS updated_at
FROM products p JOIN results r USING (product_id)""")
oracle("q_resolve_content_issues", ISSUES, f"""
SELECT issue_id, issue_type, resolved OR closed AS resolved,
       {stamp("CASE WHEN closed THEN TIMESTAMP '2024-06-01' ELSE resolved_at END")} AS resolved_at
FROM (SELECT i.*, issue_type IN ('missing_description', 'thin_content') AND category <> 'PROMO' AS closed
      FROM issue_table i JOIN products USING (product_id))""")

# --- streams ---
STREAM_PRICES = ("""
looked AS (
  SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous
  FROM events WHERE value IS NOT NULL),
compared AS (
  SELECT *, upper(event_type[1:1]) || event_type[2:] AS name, 10.0::DOUBLE AS ours,
         CASE WHEN previous <> 0 THEN abs((value - previous) / previous) * 100 END AS change
  FROM looked WHERE value <> 0)""", """
SELECT user_id AS product_id, event_type AS source, 'undercut' AS alert_type, value AS competitor_price,
       ours - value AS price_difference,
       name || ' is selling a similar product at USD ' || printf('%.2f', value) || ', which is '
         || printf('%.1f', ((ours - value) / ours) * 100) || '% lower than your price of USD 10.00.' AS message
FROM compared WHERE value < ours AND ((ours - value) / ours) * 100 >= 5
UNION ALL
SELECT user_id, event_type, CASE WHEN value < previous THEN 'price_drop' ELSE 'price_increase' END, value,
       abs(value - previous),
       'Competitor on ' || name || CASE WHEN value < previous THEN ' dropped' ELSE ' increased' END
         || ' price by ' || printf('%.1f', change) || '% (from ' || printf('%.2f', previous) || ' to '
         || printf('%.2f', value) || ').'
FROM compared WHERE change >= 10""")
for name in ("q_stream_prices", "q_stream_late_prices"):
    oracle(name, *STREAM_PRICES)
oracle("q_stream_feed_headers", "", """
SELECT 'S-' || s_suppkey AS sku, s_name || ' second "line"' AS title, s_suppkey::DOUBLE AS price FROM supplier
UNION ALL SELECT 'job completed', NULL, count(*) FROM supplier
UNION ALL SELECT 'job failed', 'Failed to parse CSV: ' || count(*) || ' lines have more fields than the header', 0
FROM supplier""")

# --- the store ---
TWO_FEEDS = """
counts AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 2 = 1) AS odd FROM part)"""
oracle("q_feed_twice", TWO_FEEDS, """
SELECT 'job 1 first completed' AS what, n AS total_rows, n AS new_products, 0::BIGINT AS updated_products,
       2 * n AS issues_found FROM counts
UNION ALL SELECT 'job 2 second completed', 2 * n, odd, 2 * n - odd, 4 * n FROM counts
UNION ALL SELECT 'catalog', n + odd, odd, n - odd, n FROM counts
UNION ALL SELECT 'issue ' || kind, 3 * n, 2 * n, n + odd, 0
FROM counts, (SELECT unnest(['missing_description', 'missing_attributes']) AS kind)""")
oracle("q_store_resolved", TWO_FEEDS, """
SELECT 'missing_description' AS kind, true AS done, 3 * n AS rows, '2024-06-02 00:00:00' AS done_at FROM counts
UNION ALL SELECT 'missing_attributes', false, 3 * n, NULL FROM counts
UNION ALL SELECT 'alert', o_orderstatus = 'F' OR o_orderkey IN (SELECT l_orderkey FROM lineitem), count(*), NULL
FROM orders GROUP BY ALL""")
oracle("q_store_cascade", TWO_FEEDS, """
SELECT 'products' AS table_name, n AS rows FROM counts
UNION ALL SELECT 'data_issues', 2 * n + 4 * (n - odd) FROM counts UNION ALL SELECT 'ingestion_jobs', 2""")
oracle("q_kept_counts", TWO_FEEDS, """
SELECT what, found FROM (SELECT unnest([
  {'what': 'total_products', 'found': n::VARCHAR}, {'what': 'active_products', 'found': '0'},
  {'what': 'flagged_products', 'found': n::VARCHAR}, {'what': 'products_without_description', 'found': n::VARCHAR},
  {'what': 'open_issues', 'found': (n + 2 * (n - odd))::VARCHAR}, {'what': 'recent_alerts', 'found': '0'},
  {'what': 'last_ingestion', 'found': '2024-06-02 00:00:00'},
  {'what': 'products with open issues: 1', 'found': odd::VARCHAR},
  {'what': 'products with open issues: 3', 'found': (n - odd)::VARCHAR}], recursive := true) FROM counts)""")
STORED = """
stored AS (
  SELECT p_partkey AS product_id, 'SKU-' || p_partkey AS sku, p_name, p_brand,
         make_timestamp(((p_partkey * 7919) % 100000) * 1000000) AS changed FROM part)"""
oracle("q_indexed_search", STORED, """
SELECT pattern, product_id, sku FROM stored,
       (SELECT unnest(['blue', 'SKU-12', 'rand#1', 'la%ge', 'd_h', 'no such thing', 'ot r']) AS pattern)
WHERE p_name ILIKE '%' || pattern || '%' OR sku ILIKE '%' || pattern || '%' OR p_brand ILIKE '%' || pattern || '%'""")
oracle("q_directory_page", STORED, f"""
SELECT product_id, sku, {stamp('changed')} AS updated_at FROM stored ORDER BY changed DESC, product_id
LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM part)""")
oracle("q_feed_outcomes", "counts AS (SELECT count(*) AS n FROM supplier)", """
SELECT 1::BIGINT AS job_id, 'no-sku' AS filename, 'failed' AS status, n AS total_rows, 0::BIGINT AS processed_rows,
       0::BIGINT AS issues_found,
       'CSV must contain a SKU/product_id column. Found columns: s_name, s_acctbal' AS error_message FROM counts
UNION ALL SELECT 2, 'no-csv', 'failed', 0, 0, 0, 'Unexpected error: No columns to parse from file'
UNION ALL SELECT 3, 'long-lines', 'failed', n, 0, 0,
       'Failed to parse CSV: ' || n || ' lines have more fields than the header' FROM counts
UNION ALL SELECT 4, 'whole', 'completed', n, n, 2 * n, NULL FROM counts
UNION ALL SELECT 5, 'whole.txt', 'failed', 0, 0, 0, 'File must be a CSV file (.csv extension).'""")
oracle("q_feed_column_orders", "", """
SELECT 'S-' || s_suppkey AS sku, s_name AS title, s_suppkey::DOUBLE AS price,
       CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'nation=n' || s_nationkey END AS attributes FROM supplier""")

# --- branches of arguments ---
oracle("q_brand_contradictions", """
titled AS (
  SELECT p_partkey AS product_id, p_name, split_part(lower(p_name), ' ', 1) AS word,
         CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) ELSE p_brand END AS brand
  FROM part)""", """
SELECT product_id, 'Brand' AS field, 'title' AS source, brand AS expected,
       'Title starts with \'\'' || word || '\'\' instead of brand' AS actual
FROM titled WHERE NOT contains(lower(p_name), lower(brand)) AND word <> lower(brand) AND length(word) > 2""".replace("\\'", "'"))
oracle("q_scrape_ids", f"{PRODUCTS}, {SEARCH}", """
SELECT product_id, source, search_url FROM targets
WHERE source = 'walmart' AND product_id IN (SELECT s_nationkey FROM supplier)""")
oracle("q_product_lists", f"{PRICES}", f"""
(SELECT 'price' AS kind, price_id AS id, product_id, {stamp('scraped_at')} AS at FROM prices
 WHERE product_id = 7 ORDER BY scraped_at DESC, price_id DESC LIMIT 50)
UNION ALL
(SELECT 'alert', o_orderkey, o_custkey, {stamp('o_orderdate')} FROM orders
 WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)""")
oracle("q_page_forms", "", """
SELECT page_id, page_id AS product_id, CASE page_id % 2 WHEN 1 THEN 'walmart' ELSE 'flipkart' END AS source,
       (CASE WHEN n = 0 THEN 0 ELSE n - 1 END)::INTEGER AS listing_rank, 'Offer ' || n || ' of ' || page_id AS title,
       page_id::DOUBLE AS price,
       CASE page_id % 2 WHEN 1 THEN 'https://other.example/' ELSE 'https://www.flipkart.com/p/' END
         || page_id || '-' || n AS url
FROM pages, (SELECT unnest([0, 2, 3, 4]) AS n)""")
oracle("q_generate_plain", GENERATED, """
SELECT product_id, generated_description, NULL::VARCHAR AS seo_title, NULL::VARCHAR AS seo_keywords, success, error
FROM results, (SELECT unnest([1, 2])) WHERE product_id IN (SELECT product_id FROM products)""")
