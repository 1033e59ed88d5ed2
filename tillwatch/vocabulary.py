"""Names that appear in events. Fixed values."""

# States
PENDING = "PENDING"
PARTIAL = "PARTIAL"
DONE = "DONE"
TIMED_OUT = "TIMED_OUT"
DEGRADED = "DEGRADED"
REPLACED = "REPLACED"

# Machine statuses (DONE is shared with the states)
DELIVERED = "DELIVERED"
DELIVERED_NO_ACK = "DELIVERED_NO_ACK"
FAILED = "FAILED"
MISSING = "MISSING"

# Faults
DUPLICATE_KEY = "DUPLICATE_KEY"
LATE_POS_RESPONSE = "LATE_POS_RESPONSE"
CONFLICTING_STATUS = "CONFLICTING_STATUS"
MISSING_POS = "MISSING_POS"
CONSUMER_ACK_MISSING = "CONSUMER_ACK_MISSING"
MISSING_STORE = "MISSING_STORE"
OFFSET_MISMATCH = "OFFSET_MISMATCH"
PREMATURE_REPUBLISH = "PREMATURE_REPUBLISH"
