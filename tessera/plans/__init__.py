"""Physical strategies: indexes that prune before the exact distance, and the choice between them."""
