"""Feed readers, the derived payment tables and the ledger."""
