"""Column names of the request fact table (snake_case of the raw headers)."""

REQUEST_ID = "service_request_id"
SERVICE_TYPE = "service_type"
LEVEL1 = "service_level_1"
LEVEL2 = "service_level_2"
CREATED = "date_created"
CLOSED = "date_closed"
STATUS = "status_type"
FCR = "first_call_resolution"
DISTRICT = "electoral_district"
NEIGHBOURHOOD = "neighbourhood"
DESCRIPTION = "description"

# Stable total order of request rows (the request id alone is not unique).
ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
