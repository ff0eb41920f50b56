"""Multi-step searches and the registered queries."""
