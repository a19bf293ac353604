"""Operations on tables that are not clauses of a query."""
