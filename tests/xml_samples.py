"""Invented documents of each layout."""

KEY = "35240111222333000181550010000001231000001234"

NFE = f"""<?xml version="1.0" encoding="UTF-8"?>
<nfeProc versao="4.00" xmlns="http://www.portalfiscal.inf.br/nfe"><NFe><infNFe Id="NFe{KEY}" versao="4.00">
<ide><cUF>35</cUF><natOp>Venda  de mercadoria</natOp><mod>55</mod><serie>1</serie><nNF>123</nNF><dhEmi>2024-01-05T10:00:00-03:00</dhEmi><tpAmb>1</tpAmb></ide>
<emit><CNPJ>11222333000181</CNPJ><xNome>Casa  Exemplo LTDA</xNome><enderEmit><xLgr>Rua A</xLgr><nro>10</nro><xBairro>Centro</xBairro><xMun>Santos</xMun><UF>SP</UF><CEP>11010000</CEP></enderEmit><IE>123456</IE></emit>
<dest><CPF>52998224725</CPF><xNome>Maria Souza</xNome><enderDest><xLgr>Rua B</xLgr><nro>5</nro><xMun>Campinas</xMun><UF>SP</UF></enderDest></dest>
<det nItem="1"><prod><cProd>P1</cProd><xProd>Cerveja</xProd><NCM>22030000</NCM><CFOP>5102</CFOP><uCom>UN</uCom><qCom>2.0000</qCom><vUnCom>10.5000</vUnCom><vProd>21.00</vProd></prod>
<imposto><ICMS><ICMS00><orig>0</orig><CST>00</CST><vBC>21.00</vBC><pICMS>18.00</pICMS><vICMS>3.78</vICMS><pFCP>2.00</pFCP><vFCP>0.42</vFCP></ICMS00></ICMS>
<IPI><IPITrib><CST>50</CST><vBC>21.00</vBC><pIPI>5.00</pIPI><vIPI>1.05</vIPI></IPITrib></IPI>
<PIS><PISAliq><CST>01</CST><vBC>21.00</vBC><pPIS>1.65</pPIS><vPIS>0.35</vPIS></PISAliq></PIS><COFINS><COFINSAliq><CST>01</CST><vBC>21.00</vBC><pCOFINS>7.60</pCOFINS><vCOFINS>1.60</vCOFINS></COFINSAliq></COFINS></imposto></det>
<det nItem="2"><prod><cProd>P2</cProd><xProd>Livro</xProd><NCM>49019900</NCM><CFOP>5102</CFOP><uCom>UN</uCom><qCom>1</qCom><vUnCom>30</vUnCom><vProd>30.00</vProd></prod>
<imposto><ICMS><ICMS60><orig>0</orig><CST>60</CST><vBCSTRet>30.00</vBCSTRet><vICMSSTRet>5.40</vICMSSTRet></ICMS60></ICMS><PIS><PISOutr><CST>99</CST><vPIS>0.10</vPIS></PISOutr></PIS></imposto></det>
<total><ICMSTot><vICMS>9.18</vICMS><vProd>51.00</vProd><vFrete>1.00</vFrete><vDesc>0.00</vDesc><vIPI>1.05</vIPI><vPIS>0.35</vPIS><vCOFINS>1.60</vCOFINS><vNF>53.05</vNF></ICMSTot></total>
<transp><modFrete>0</modFrete><veicTransp><placa>ABC1D23</placa><UF>SP</UF></veicTransp><vol><qVol>3</qVol><pesoL>1.500</pesoL><pesoB>2.000</pesoB></vol></transp>
<pag><detPag><tPag>17</tPag><vPag>53.05</vPag></detPag></pag></infNFe></NFe>
<protNFe><infProt><nProt>135</nProt><dhRecbto>2024-01-05T10:01:00-03:00</dhRecbto><cStat>100</cStat><xMotivo>Autorizado</xMotivo></infProt></protNFe></nfeProc>"""

NFCE = """<NFe><infNFe Id="NFe35240111222333000181650010000000011000000011"><ide><mod>65</mod><serie>2</serie><nNF>1</nNF><dEmi>2024-02-01</dEmi></ide>
<emit><CNPJ>11222333000181</CNPJ><xNome>Loja</xNome></emit><dest><CPF>11144477735</CPF></dest><total><ICMSTot><vNF>10.00</vNF></ICMSTot></total>
<pag><detPag><tPag>01</tPag><vPag>20.00</vPag></detPag><vTroco>10.00</vTroco></pag></infNFe></NFe>"""

CTE = """<cteProc><CTe><infCte Id="CTe1"><ide><mod>57</mod><serie>1</serie><nCT>77</nCT><dhEmi>2024-03-01T00:00:00-03:00</dhEmi></ide><emit><CNPJ>11444777000161</CNPJ><xNome>Transportes X</xNome><enderEmit><UF>PR</UF></enderEmit></emit>
<rem><CNPJ>11222333000181</CNPJ><xNome>Remetente</xNome><enderReme><xLgr>Rua R</xLgr><xMun>Curitiba</xMun><UF>PR</UF></enderReme></rem>{dest}<vPrest><vTPrest>150.00</vTPrest></vPrest>
<infCTeNorm><infCarga><vCarga>9000.00</vCarga><infQ><cUnid>01</cUnid><qCarga>5.0</qCarga></infQ><infQ><cUnid>03</cUnid><qCarga>12</qCarga></infQ></infCarga><infModal><rodo><veic><placa>XYZ0A00</placa><UF>PR</UF></veic></rodo></infModal></infCTeNorm></infCte></CTe></cteProc>"""
CTE_OK = CTE.format(dest="<dest><CNPJ>11444777000161</CNPJ><xNome>Destino</xNome><enderDest><UF>SC</UF></enderDest></dest>")
CTE_REM_ONLY = CTE.format(dest="")

MDFE = f"""<MDFe><infMDFe><ide><mod>58</mod><serie>1</serie><nMDF>9</nMDF><dIniViagem>2024-04-02</dIniViagem></ide><emit><CNPJ>11222333000181</CNPJ><xNome>Frota</xNome><enderEmit><UF>RS</UF></enderEmit></emit>
<infModal><rodo><veicTracao><placa>AAA1111</placa><UF>RS</UF></veicTracao></rodo></infModal><infDoc><chNFe>{KEY}</chNFe></infDoc><tot><qCTe>4</qCTe><vCarga>1000.50</vCarga></tot></infMDFe></MDFe>"""

CFE = """<CFe><infCFe Id="CFe1"><ide><mod>59</mod><nCFe>000045</nCFe><serie>3</serie><dEmi>2024-05-06</dEmi></ide><emit><CNPJ>11222333000181</CNPJ><xNome>Mercado</xNome><enderEmit><xLgr>Av C</xLgr><xMun>Santos</xMun></enderEmit></emit><dest/>
<det nItem="1"><prod><xProd>Pão</xProd><qCom>1</qCom><vUnCom>8,50</vUnCom><vProd>8,50</vProd></prod></det><total><vCFe>8.50</vCFe></total><pgto><MP><cMP>01</cMP><vMP>5.00</vMP></MP><MP><cMP>03</cMP><vMP>5.00</vMP></MP><vTroco>1.50</vTroco></pgto></infCFe></CFe>"""

NFSE_ABRASF = """<CompNfse><Nfse><InfNfse><DataEmissao>2024-06-07T00:00:00</DataEmissao><PrestadorServico><RazaoSocial>Serviços S</RazaoSocial><Cnpj>11444777000161</Cnpj><Endereco><Endereco>Rua S</Endereco><Numero>1</Numero><CodigoMunicipio>3550308</CodigoMunicipio></Endereco></PrestadorServico>
<TomadorServico><RazaoSocial>Cliente</RazaoSocial><Cnpj>11222333000181</Cnpj></TomadorServico><Servico><Valores><ValorServicos>200.00</ValorServicos><Aliquota>0.05</Aliquota></Valores><ItemListaServico>1.07</ItemListaServico></Servico></InfNfse></Nfse></CompNfse>"""

NFSE_NACIONAL = """<NFSe><infNFSe><emit><CNPJ>11222333000181</CNPJ><xNome>Nacional</xNome><enderNac><xLgr>Rua N</xLgr><cMun>3304557</cMun></enderNac></emit><toma><CPF>52998224725</CPF><xNome>Pessoa</xNome></toma><valores><vLiq>99.90</vLiq></valores><dhEmi>2024-07-08T01:00:00</dhEmi><cTribNac>010701</cTribNac></infNFSe></NFSe>"""

GENERIC = "<qualquer><ide><nNF>5</nNF></ide><emit><xNome>Alguém</xNome><CNPJ>11.222.333/0001-81</CNPJ></emit><total><vNF>12.00</vNF></total></qualquer>"

PREFIXED = NFCE.replace("<", "<n:").replace("<n:/", "</n:").replace("<n:NFe>", '<n:NFe xmlns:n="urn:x">').replace("n:emit", "n:EMIT")

EMPTY_ICMS = "<NFe><infNFe><ide><mod>55</mod></ide><det nItem='1'><prod><xProd>A</xProd></prod><imposto><ICMS/><ICMSUFDest><vBCUFDest>10.00</vBCUFDest><pICMSUFDest>7.00</pICMSUFDest><vICMSUFDest>0.70</vICMSUFDest></ICMSUFDest></imposto></det></infNFe></NFe>"

LATIN1 = "<qualquer><emit><xNome>Padaria São João</xNome></emit></qualquer>".encode("latin-1")
MALFORMED = b"<NFe><infNFe><ide>"
ENTITIES = b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>'
