"""marlgate.plans: expression compiler and query catalogue."""
