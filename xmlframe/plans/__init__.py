"""XPath over node tables and documents."""
