"""Set-level operators on tables of notices. All take explicit times; none reads the clock."""
