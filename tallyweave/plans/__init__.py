"""Rules, the reconciliation run and the registered queries."""
