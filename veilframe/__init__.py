"""Detection, redaction and verification of declared personal data over DataFrames."""
