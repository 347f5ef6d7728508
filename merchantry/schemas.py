"""Column types of the model tables, as DDL strings for createDataFrame and readers."""

CUSTOMERS = (
    "customer_id bigint, email string, first_name string, last_name string, phone string, "
    "date_of_birth date, customer_status string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
ADDRESSES = (
    "address_id bigint, customer_id bigint, address_type string, street_address string, "
    "street_address_2 string, city string, state string, postal_code string, country string, "
    "is_default boolean"
)
CATEGORIES = (
    "category_id string, parent_category_id string, category_name string, category_slug string, "
    "description string, is_active boolean, sort_order int"
)
PRODUCTS = (
    "product_id bigint, category_id string, sku string, product_name string, product_slug string, "
    "description string, price decimal(18,2), cost decimal(18,2), is_active boolean, "
    "stock_quantity bigint, reorder_level bigint"
)
ORDERS = (
    "order_id bigint, customer_id bigint, order_number string, order_status string, "
    "billing_address_id bigint, shipping_address_id bigint, subtotal decimal(18,2), "
    "tax_amount decimal(18,2), shipping_amount decimal(18,2), discount_amount decimal(18,2), "
    "total_amount decimal(18,2), payment_status string, payment_method string, created_at timestamp_ntz"
)
ORDER_ITEMS = (
    "order_id bigint, product_id bigint, quantity bigint, unit_price decimal(18,2), "
    "total_price decimal(18,2)"
)
INVENTORY_MOVEMENTS = (
    "product_id bigint, movement_type string, quantity bigint, reference_type string, "
    "reference_id bigint, movement_date timestamp_ntz, created_by string"
)
AUDIT_LOG = (
    "id bigint, table_name string, operation string, record_id string, old_values string, "
    "new_values string, changed_by string, changed_at timestamp_ntz, session_id string, "
    "application_name string, ip_address string, user_agent string"
)
AUDIT_CONFIG = (
    "table_name string, is_enabled boolean, audit_inserts boolean, audit_updates boolean, "
    "audit_deletes boolean, excluded_columns array<string>, retention_days int"
)

# The members each enumerated column may hold.
DOMAINS = {
    "customer_status": ["active", "inactive", "suspended"],
    "address_type": ["billing", "shipping", "both"],
    "order_status": ["pending", "processing", "shipped", "delivered", "cancelled", "refunded"],
    "payment_status": ["pending", "paid", "failed", "refunded"],
    "movement_type": ["in", "out", "adjustment"],
    "reference_type": ["purchase", "sale", "adjustment", "damage", "return"],
    "operation": ["INSERT", "UPDATE", "DELETE"],
    "customer_segment": ["new", "regular", "vip", "churned", "at_risk"],
    "lifetime_value_tier": ["low", "medium", "high", "premium"],
    "performance_tier": ["low", "medium", "high", "top"],
    "velocity_category": ["slow", "normal", "fast", "very_fast"],
}
