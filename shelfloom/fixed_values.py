"""Values that results depend on, stated as plain data.

Everything in this module is a FIXED VALUE: word lists, lookup tables,
thresholds, message and prompt texts. Changing one changes results. Order is
part of the value wherever "first match wins".
"""

# --- FIXED VALUES: feed reading -------------------------------------------

# Whole-field texts that count as a missing value (case-sensitive).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# Words that blank out a text field after trimming (lower case).
BLANK_WORDS = ["nan", "none"]

# The words that blank out one of the five standard attributes.
BLANK_ATTRIBUTE_WORDS = ["nan", "none", "", "n/a"]

# Standard field -> header spellings, in order of preference.
HEADER_ALIASES = {
    "sku": ["sku", "product_id", "item_id", "item_number", "product_code", "asin"],
    "title": ["title", "name", "product_name", "item_name", "product_title"],
    "description": ["description", "desc", "product_description", "long_description", "details"],
    "category": ["category", "product_category", "type", "product_type", "department"],
    "brand": ["brand", "manufacturer", "vendor", "brand_name"],
    "price": ["price", "retail_price", "list_price", "sale_price", "unit_price"],
    "currency": ["currency", "currency_code"],
    "color": ["color", "colour"],
    "size": ["size", "sizes", "dimensions"],
    "material": ["material", "materials", "fabric"],
    "weight": ["weight", "item_weight", "shipping_weight"],
    "upc": ["upc", "ean", "barcode", "gtin"],
}

ATTRIBUTE_FIELDS = ["color", "size", "material", "weight", "upc"]

DEFAULT_CURRENCY = "USD"

# --- FIXED VALUES: attribute dictionaries ---------------------------------

SIZE_KEYS = ["size", "sizes"]
COLOR_KEYS = ["color", "colour", "colors"]
MATERIAL_KEYS = ["material", "materials", "fabric"]

SIZES = {
    "xs": "XS", "extra small": "XS", "x-small": "XS",
    "s": "S", "small": "S", "sm": "S",
    "m": "M", "medium": "M", "med": "M",
    "l": "L", "large": "L", "lg": "L",
    "xl": "XL", "extra large": "XL", "x-large": "XL",
    "xxl": "XXL", "2xl": "XXL", "xx-large": "XXL",
    "xxxl": "XXXL", "3xl": "XXXL",
}

COLORS = {
    "blk": "Black", "bk": "Black",
    "wht": "White", "wh": "White",
    "blu": "Blue", "bl": "Blue",
    "rd": "Red",
    "grn": "Green", "gn": "Green",
    "gry": "Grey", "gray": "Grey",
    "ylw": "Yellow", "yl": "Yellow",
    "pnk": "Pink", "pk": "Pink",
    "prpl": "Purple",
    "org": "Orange",
    "brn": "Brown",
    "navy": "Navy Blue",
}

MATERIALS = {
    "ss": "Stainless Steel", "stainless": "Stainless Steel",
    "alum": "Aluminum", "aluminium": "Aluminum",
    "poly": "Polyester",
    "ctn": "Cotton",
    "nyl": "Nylon",
    "lth": "Leather", "lthr": "Leather",
    "wl": "Wool",
    "syn": "Synthetic",
}

# --- FIXED VALUES: quality rules ------------------------------------------

# Colors looked for in titles and descriptions; the first one found counts.
KNOWN_COLORS = [
    "black", "white", "blue", "red", "green", "grey", "gray",
    "yellow", "pink", "purple", "orange", "brown", "navy",
    "silver", "gold", "beige", "tan",
]

CONTRADICTION_COLOR_KEYS = ["color", "colour"]

GENERIC_PHRASES = [
    "high quality", "best quality", "buy now", "click here",
    "lorem ipsum", "description not available", "n/a",
]

# (bound, penalty, text): under 20 words, under 50 words, over 300 words.
VERY_THIN = (20, 40, "Very thin content (under 20 words)")
SHORT = (50, 20, "Short content (under 50 words)")
TOO_LONG = (300, 10, "Content may be too long (over 300 words)")
FEW_SENTENCES = (2, 15, "Too few sentences")
GENERIC_PENALTY = 10
NO_DESCRIPTION = "No description"

# Label -> lowest score that earns it.
SCORE_LABELS = {"Good": 80, "Fair": 50, "Poor": 20, "Critical": 0}
THIN_SCORE = 50

REQUIRED_ATTRIBUTES = ["color", "size", "material"]
MISSING_ATTRIBUTES_FROM = 2

MISSING_DESCRIPTION_TEXT = (
    "Product '{sku}' has no description. SEO content generation recommended."
)
THIN_CONTENT_TEXT = (
    "Product '{sku}' has thin content (score: {score}/100, {words} words). Issues: {issues}"
)
CONTRADICTION_TEXT = (
    "Contradiction detected in '{field}': attribute says '{expected}' but {actual}"
)
MISSING_ATTRIBUTES_TEXT = (
    "Product '{sku}' is missing attributes: {missing}. "
    "Adding these can improve content quality."
)
COLOR_FOUND_TEXT = "'{color}' found in {source}"
BRAND_FOUND_TEXT = "Title starts with '{word}' instead of brand"
GENERIC_FOUND_TEXT = "Generic/placeholder text detected: '{phrase}'"

# --- FIXED VALUES: feed job messages --------------------------------------

EMPTY_FEED_TEXT = "CSV file is empty or contains only headers."
NOT_CSV_TEXT = "File must be a CSV file (.csv extension)."
NO_SKU_TEXT = "CSV must contain a SKU/product_id column. Found columns: {columns}"
PARSE_ERROR_TEXT = "Failed to parse CSV: {error}"
OTHER_ERROR_TEXT = "Unexpected error: {error}"

# --- FIXED VALUES: marketplaces and prices --------------------------------

SOURCES = ["amazon", "walmart", "flipkart"]

SEARCH_URLS = {
    "amazon": "https://www.amazon.com/s?k=",
    "walmart": "https://www.walmart.com/search?q=",
    "flipkart": "https://www.flipkart.com/search?q=",
}
DEFAULT_SEARCH_SOURCE = "amazon"

# How a listing is read off a marketplace page, as CSS selectors: tag, .class and [attribute]
# or [attribute='value'], a space for any descendant. Alternatives are tried in order.
LISTING_RULES = {
    "amazon": {
        "containers": ["div[data-component-type='s-search-result']"],
        "title": ["h2 a span"],
        "price": ["span.a-price-whole"],
        "price_fraction": ["span.a-price-fraction"],
        "link": ["h2 a"],
        "host": "https://www.amazon.com",
        "keep_absolute_links": False,
        "currency": "USD",
    },
    "walmart": {
        "containers": ["div[data-item-id]"],
        "title": ["span[data-automation-id='product-title']"],
        "price": ["div[data-automation-id='product-price'] span"],
        "price_fraction": [],
        "link": ["a[link-identifier]"],
        "host": "https://www.walmart.com",
        "keep_absolute_links": True,
        "currency": "USD",
    },
    "flipkart": {
        "containers": ["div._1AtVbE", "div.tUxRFH"],
        "title": ["div._4rR01T", "a.IRpwTa"],
        "price": ["div._30jeq3"],
        "price_fraction": [],
        "link": ["a._1fQZEK", "a.IRpwTa"],
        "host": "https://www.flipkart.com",
        "keep_absolute_links": False,
        "currency": "INR",
    },
}
CONTAINERS_PER_PAGE = 5

INR_PER_USD = 83.0
UNDERCUT_PERCENT = 5
CHANGE_PERCENT = 10

UNDERCUT_TEXT = (
    "{source} is selling a similar product at {currency} {price}, which is "
    "{percent}% lower than your price of {our_currency} {our_price}."
)
OUT_OF_STOCK_TEXT = (
    "Competitor on {source} is OUT OF STOCK for a similar product. "
    "This is a buying opportunity — consider promoting your listing."
)
PRICE_DROP_TEXT = "Competitor on {source} dropped price by {percent}% (from {previous} to {price})."
PRICE_INCREASE_TEXT = "Competitor on {source} increased price by {percent}% (from {previous} to {price})."

SCRAPED_STATUSES = ["active", "flagged"]

# --- FIXED VALUES: content generation -------------------------------------


DESCRIPTION_SYSTEM = "You are a professional e-commerce copywriter."
SEO_SYSTEM = "You are an SEO specialist. Return only valid JSON."
DESCRIPTION_CALL = {"temperature": 0.7, "max_tokens": 500}
SEO_CALL = {"temperature": 0.3, "max_tokens": 200}

DESCRIPTION_PROMPT = """You are an expert e-commerce copywriter. Write a compelling, SEO-optimized product description.

STRICT RULES:
1. Use ONLY the facts provided below. Do NOT invent any specifications, features, or claims.
2. If an attribute is not listed, do NOT mention it or guess it.
3. Write in a {tone} tone suitable for an e-commerce product listing.
4. Include relevant keywords naturally for SEO.
5. Structure the description with a brief opening hook, key features, and a closing statement.
6. Keep the description between 80-150 words.
7. Do NOT use markdown formatting, bullet points, or headers in the description.
8. Write in flowing paragraphs.

PRODUCT INFORMATION:
- Title: {title}
- SKU: {sku}
- Category: {category}
- Brand: {brand}
- Price: {price} {currency}
{original}

PRODUCT ATTRIBUTES:
{attributes}

Write the product description now:"""

ORIGINAL_LINE = "- Original Description: {description}"
ATTRIBUTE_LINE = "  - {name}: {value}\n"
NO_ATTRIBUTES = "  No additional attributes available."
NOT_SPECIFIED = "Not specified"

SEO_PROMPT = """You are an SEO specialist. Generate SEO metadata for the following e-commerce product.

PRODUCT:
- Title: {title}
- Category: {category}
- Brand: {brand}
- Description: {description}

Generate the following in JSON format:
{{
  "seo_title": "An SEO-optimized title (max 60 characters, include primary keyword)",
  "seo_keywords": "Comma-separated list of 5-8 relevant search keywords"
}}

Return ONLY the JSON object, no other text."""

SEO_NO_CATEGORY = "General"
SEO_NO_BRAND = "Unknown"

PRODUCT_NOT_FOUND_TEXT = "Product with ID {product_id} not found."
GENERATION_FAILED_TEXT = "Content generation failed for product {product_id}: {error}"

CONTENT_ISSUE_TYPES = ["missing_description", "thin_content"]
