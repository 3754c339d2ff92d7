"""Fixed values of the substitution data model.

These literals must equal what the upstream sources emit, so they are
stated here once, plainly, and imported everywhere else.
"""

# --- fixed values -----------------------------------------------------------
# Answer spelling in the text-message response feed.
RESPONSE_ACCEPT = "Accept"
RESPONSE_REJECT = "Reject"
# Answer spelling in the clickstream feed.
CLICK_ACCEPTED = "accepted"
CLICK_REJECTED = "rejected"
# Presence flag values.
YES = "YES"
NO = "NO"
# Division number of the partner-fulfilled business in the response feed.
PARTNER_DIVISION = 540
# Substitution key shared by substitution, response and partner events.
SUB_KEYS = ("order_no", "ordered_upc", "picked_upc")
# The same key as it appears in the clickstream (after exploding sub_upc).
CLICK_KEYS = ("order_id", "upc", "sub_upc")
# Register key: a substitution is "on the register" when its picked UPC
# was rung up in the same order at the same store.
REGISTER_KEYS = ("order_no", "gtin_no", "store_code")
# Clickstream columns carried through the reconciliation, in report order
# (besides the key columns and the two flags).
CLICK_CARRIED = (
    "allow_substitutes",
    "number_of_subs",
    "substitute_method",
    "product_allow_substitutes",
    "product_substitute_method",
    "sub_name",
    "sub_price",
    "sub_type",
    "sub_units",
)
# --- end of fixed values ----------------------------------------------------

# Names of our own derived columns (not upstream values).
CLICK_RECORD = "click_record"
RESPONSE_RECORD = "response_record"
RESPONSE_STORE = "cust_resp_store_code"
RESPONSE_DATE = "response_date"
