"""ledgerweave package."""
