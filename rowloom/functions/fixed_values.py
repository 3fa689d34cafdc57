"""Names, masks and weights the privacy operators share."""

from __future__ import annotations

# Column-name patterns, first matching line wins; (category, certainty, names).
NAME_PATTERNS = [
    ("email", "detected", ["email", "email_address", "e_mail", "mail"]),
    ("email", "suspected", ["contact_email", "user_email"]),
    ("phone", "detected", ["phone", "mobile", "cell", "contact_number", "phone_number", "fax", "telephone"]),
    ("name", "detected", ["name", "full_name", "display_name", "legal_name", "user_name", "username"]),
    ("name", "detected", ["first_name", "firstname", "given_name"]),
    ("name", "detected", ["last_name", "lastname", "surname", "family_name"]),
    ("address", "detected", ["address", "street", "street_address", "home_address", "billing_address",
                             "shipping_address"]),
    ("address", "suspected", ["city", "zip", "postal_code", "state", "country"]),
    ("date_of_birth", "detected", ["dob", "date_of_birth", "birth_date", "birthdate"]),
    ("date_of_birth", "suspected", ["birth_year", "age"]),
    ("government_id", "detected", ["ssn", "tax_id", "tax_id_number", "medicare_number", "passport_no",
                                   "passport_number", "national_id", "drivers_license"]),
    ("government_id", "suspected", ["govt_id", "government_id", "id_number"]),
    ("financial", "detected", ["account_number", "card_number", "iban", "credit_card", "bank_account",
                               "routing_number", "bic"]),
    ("financial", "suspected", ["salary", "income"]),
    ("health", "detected", ["diagnosis", "condition", "prescription", "medical_record", "health_status"]),
    ("credentials", "detected", ["password", "passwd", "pwd", "secret", "token", "api_token", "api_key",
                                 "auth_token", "access_token"]),
    ("credentials", "suspected", ["credentials", "private_key"]),
    ("free_text_sensitive", "suspected", ["notes", "comments", "description", "bio"]),
]

# Generator hints that settle the category.
HINT_CATEGORIES = {"email": "email", "name": "name", "phone": "phone", "address": "address", "company": "name"}

# Masks; every other sensitive category uses the default mask.
DEFAULT_MASK = "***REDACTED***"
CATEGORY_MASKS = {"email": "***@***", "credentials": "***SECRET***"}

# Risk weights; categories without a line weigh one.
RISK_WEIGHTS = {
    "credentials": 5,
    "government_id": 5,
    "financial": 4,
    "health": 4,
    "date_of_birth": 3,
    "email": 2,
    "phone": 2,
    "address": 2,
    "free_text_sensitive": 2,
    "name": 1,
    "unknown_sensitive": 1,
}
HIGH_RISK = ("credentials", "financial", "government_id")
POINTS_PER_WEIGHT = 3
HIGH_SCORE = 70
MEDIUM_SCORE = 40

# Config keys that hold secrets, and what replaces their text.
SECRET_KEY_PARTS = ("password", "secret", "token", "credential", "uri")
SECRET_MASK = "***"

# Event types per business domain.
EVENT_TYPES = {
    "ecommerce": ["order_created", "payment_captured", "order_packed", "order_shipped", "order_delivered",
                  "order_refunded"],
    "fintech_transactions": ["payment_initiated", "payment_authorized", "payment_settled", "payment_reversed",
                             "fraud_flagged"],
    "logistics_supply_chain": ["po_created", "shipment_dispatched", "shipment_in_transit", "delivery_completed",
                               "return_created"],
    "iot_telemetry": ["reading_ingested", "threshold_breach", "alert_triggered", "maintenance_recorded"],
    "social_platform": ["post_created", "comment_added", "like_added", "follow_created", "report_created"],
    "saas_billing": ["subscription_created", "invoice_issued", "payment_received", "subscription_cancelled"],
    "payments_ledger": ["invoice_created", "payment_captured", "refund_issued", "dispute_created"],
}

# Note templates and severities.
NOTE_TEMPLATES = [
    "Customer reported issue after {event_type}. Investigate entity {entity_id}.",
    "Support note: follow-up required for {event_type} on {entity_id}.",
    "Escalation candidate tied to {event_type}; observed anomaly around entity {entity_id}.",
    "Operations comment: verify downstream impact from {event_type} for {entity_id}.",
    "Ticket opened: {event_type} triggered SLA review for {entity_id}.",
    "Internal note: {event_type} on {entity_id} may require escalation.",
    "Customer inquiry regarding {event_type} for {entity_id}. Awaiting response.",
    "QA flag: validate {event_type} handling for entity {entity_id}.",
    "Refund requested after {event_type}. Entity {entity_id} under review.",
    "Compliance check: {event_type} on {entity_id} passed audit.",
]
SEVERITIES = ["low", "medium", "high"]
