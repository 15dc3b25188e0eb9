"""Definitions and rules that several tests use."""

CUSTOMERS = """
CREATE TABLE dbo.Countries (CountryCode CHAR(2) NOT NULL PRIMARY KEY, CountryName NVARCHAR(80) NOT NULL);
GO
CREATE TABLE [dbo].[Customers] (
    CustomerId   INT IDENTITY(1,1) NOT NULL CONSTRAINT PK_Customers PRIMARY KEY,
    CustomerCode VARCHAR(20) NOT NULL UNIQUE,
    FirstName    NVARCHAR(50) NOT NULL,
    Email        NVARCHAR(120) NOT NULL,
    Phone        VARCHAR(30) NULL,
    BirthDate    DATE NULL,
    CreditLimit  DECIMAL(12,2) NOT NULL DEFAULT (0) CHECK (CreditLimit >= 0),
    IsActive     BIT NOT NULL DEFAULT 1,
    Status       VARCHAR(10) NOT NULL,
    CountryCode  CHAR(2) NOT NULL REFERENCES dbo.Countries(CountryCode) ON DELETE NO ACTION,
    CreatedAt    DATETIME2(3) NOT NULL DEFAULT (SYSUTCDATETIME()),
    ExternalId   UNIQUEIDENTIFIER NOT NULL,
    Notes        NVARCHAR(MAX) NULL,
    FullName     AS (FirstName + N' ' + Status) PERSISTED,
    RowVer       ROWVERSION,
    CONSTRAINT UQ_Email UNIQUE (Email),
    CONSTRAINT CK_Status CHECK (Status IN ('new', 'open', 'shut'))
);
"""

COUNTRY_RULES = """
rows: 8
seed: 1
columns:
  CountryCode: {strategy: pick, values: [AT, BE, DE, ES, FR, IT, "NO", PL, SE], unique: true}
  CountryName: {strategy: faker, method: address.country}
"""

CUSTOMER_RULES = """
table: dbo.Customers
rows: 1000
seed: 20260807
columns:
  CustomerId: {strategy: skip}
  CustomerCode: {strategy: template, template: "CUST-{row}", unique: true}
  FirstName: {strategy: faker, method: name.firstName}
  Email: {strategy: template, template: "user{row}@example.test"}
  Phone: {strategy: faker, method: phone.phoneNumber, nullRate: 0.2}
  BirthDate: {strategy: date, min: "1955-01-01", max: "2005-12-31", nullRate: 0.1}
  CreditLimit: {strategy: decimal, min: 0, max: 50000}
  IsActive: {strategy: bool, trueRate: 0.9}
  Status: {strategy: pick, values: [new, open, shut], weights: [0.7, 0.2, 0.1]}
  CountryCode: {strategy: query, query: "SELECT CountryCode FROM dbo.Countries"}
  CreatedAt: {strategy: datetime, min: "2024-01-01", max: "2026-06-30"}
  ExternalId: {strategy: guid, unique: true}
  Notes: {strategy: faker, method: lorem.sentence, nullRate: 0.5}
evaluations:
  - {name: row-count, query: "SELECT COUNT(*) FROM [dbo].[Customers]", expect: {equals: 1000}}
  - {name: email-unique, query: "SELECT COUNT(*) - COUNT(DISTINCT Email) FROM dbo.Customers", expect: {equals: 0}}
  - {name: status-known, query: "SELECT COUNT(*) FROM dbo.Customers WHERE Status NOT IN ('new', 'open', 'shut')", expect: {equals: 0}}
  - {name: active-share, query: "SELECT CAST(SUM(CASE WHEN IsActive = 1 THEN 1.0 ELSE 0.0 END)/COUNT(*) AS FLOAT) FROM dbo.Customers", expect: {between: [0.85, 0.95]}}
  - {name: orphans, query: "SELECT COUNT(*) FROM dbo.Customers c LEFT JOIN dbo.Countries k ON c.CountryCode = k.CountryCode WHERE k.CountryCode IS NULL", expect: {equals: 0}}
  - {name: phone-nulls, query: "SELECT CAST(SUM(IIF(Phone IS NULL, 1.0, 0.0))/COUNT(*) AS FLOAT) FROM dbo.Customers", expect: {min: 0.15, max: 0.25}}
  - {name: credit, query: "SELECT AVG(CreditLimit) FROM dbo.Customers"}
"""
