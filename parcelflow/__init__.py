"""parcelflow: support-conversation and parcel jobs written as plain PySpark DataFrame code."""
