"""Chains of operators and questions about past runs."""
