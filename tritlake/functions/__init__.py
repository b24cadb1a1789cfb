"""Column functions: pixels and trits in, arrays of integers out. All are narrow, native expressions."""
