"""A DataFrame engine for collections of legal and administrative documents."""
