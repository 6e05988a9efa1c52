"""Explicit schemas of review, catalog and aspect records and of the graph tables."""

from __future__ import annotations

REVIEW = "user_id string, asin string, parent_asin string, rating double, timestamp bigint, title string, text string, verified_purchase boolean, helpful_vote bigint"
METADATA = "parent_asin string, asin string, title string, main_category string, store string, brand string, average_rating string, rating_number bigint, price string, description string, features string, categories string, details string, bought_together string"
ASPECT = "review_id string, aspect string, surface_form string, opinion string, sentiment string, confidence double, model_version string"

#: Keys of node tables; of edge tables the pair (src, dst) is the key.
NODE_KEYS = {
    "User": "user_id", "Review": "review_id", "ParentProduct": "asin", "ProductVariant": "asin", "Brand": "brand_id",
    "Category": "category_id", "Attribute": "attribute_id", "PriceRange": "bucket_id", "CoPurchaseSet": "set_id", "Aspect": "aspect_name",
}
