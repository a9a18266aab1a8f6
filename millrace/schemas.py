"""Record types. product_information is an array, as its order is visible in rendered text."""

from __future__ import annotations

# Names and types of fields.
KV = "array<struct<k:string,v:string>>"
KEY_ATTRIBUTES = "struct<availability_text:string,price_excl_tax:double,price_incl_tax:double,product_type:string,review_count:int,tax:double,upc:string>"
PAYLOAD = f"struct<availability:struct<in_stock:boolean,stock_count:int>,category:string,currency:string,key_attributes:{KEY_ATTRIBUTES},price:double,rating:int,title:string>"
PRODUCTS = f"seq long, product_url string, title string, raw_breadcrumb array<string>, category string, price double, currency string, availability_text string, in_stock boolean, stock_count int, rating int, raw_rating_text string, description string, product_information {KV}, image_url string, scraped_at string"
#: As products lie in JSON lines: numbers as text, which the casts read; an object for the attributes, ordered by its text on read.
PRODUCTS_JSON = "product_url string, title string, raw_breadcrumb array<string>, category string, price string, currency string, availability_text string, in_stock boolean, stock_count string, rating string, raw_rating_text string, description string, product_information string, image_url string, scraped_at string"
SFT = "seq long, instruction string, input string, output string"
PREDICTION = "idx long, sample_id string, model_name string, input string, raw_response string, parsed_json string, parse_ok boolean, schema_ok boolean, error_reason string"

# Leaf paths of a label, in order, and the names of their accuracy rates.
LEAVES = ("title", "category", "price", "currency", "availability.in_stock", "availability.stock_count", "rating", "key_attributes.upc", "key_attributes.product_type", "key_attributes.price_excl_tax", "key_attributes.price_incl_tax", "key_attributes.tax", "key_attributes.availability_text", "key_attributes.review_count")
RATES = ("title_exact_match_rate", "category_exact_match_rate", "price_exact_match_rate", "currency_match_rate", "in_stock_match_rate", "stock_count_match_rate", "rating_match_rate", "upc_match_rate", "product_type_match_rate", "price_excl_tax_exact_match_rate", "price_incl_tax_exact_match_rate", "tax_exact_match_rate", "availability_text_match_rate", "review_count_match_rate")
NUMERIC_4 = ("price", "key_attributes.price_excl_tax", "key_attributes.price_incl_tax", "key_attributes.tax")
NUMERIC_7 = ("price", "availability.stock_count", "rating", "key_attributes.price_excl_tax", "key_attributes.price_incl_tax", "key_attributes.tax", "key_attributes.review_count")
DROP_REASONS = ("invalid_output_json", "mojibake_detected", "price_parse_failed", "key_attr_parse_failed", "category_default_dropped", "rating_out_of_range", "other_exception")
FIXES = ("mojibake_fixed", "currency_symbol_stripped", "category_default_to_null", "description_deduped", "key_attr_numeric_cast")
